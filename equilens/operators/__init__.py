"""DataFrame operators: lazy, no collect inside, column names as arguments."""
