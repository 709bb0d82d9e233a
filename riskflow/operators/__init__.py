"""DataFrame operators. Each is ``f(df, ...params) -> DataFrame`` and lazy."""
