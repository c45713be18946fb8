"""Small builders shared by the tests."""

from collections import Counter


def process(operation, **data_map):
    return {"operation": operation, "data_map": data_map}


def rows(df):
    """Rows as a multiset of tuples, NaN made comparable."""
    return Counter(tuple("NaN" if v != v else v for v in row) for row in df.collect())


def column(df, name):
    return [row[0] for row in df.select(name).collect()]
