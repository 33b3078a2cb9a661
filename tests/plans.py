"""Looking at physical plans."""


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final(df) -> str:
    """The plan after adaptive execution: run once, then shown."""
    df.collect()
    return executed(df)
