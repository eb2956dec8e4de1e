"""DataFrame operators: each is ``op(df, ...) -> DataFrame``."""
