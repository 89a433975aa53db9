"""Registry of named queries: a Spark plan and, where SQL can say it, the SQL."""

QUERIES = {}
SQL = {}


def query(sql=None):
    """Register the decorated ``(spark, sf_dir) -> DataFrame`` under its own name."""
    def register(plan):
        QUERIES[plan.__name__] = plan
        if sql is not None:
            SQL[plan.__name__] = sql
        return plan
    return register
