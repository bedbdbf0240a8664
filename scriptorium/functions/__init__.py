"""Column functions: every one is a composition of built-in Spark expressions unless its docstring says otherwise."""
