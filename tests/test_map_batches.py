"""A batch function is given a bounded number of rows."""

import pandas as pd

from textforge.operators import chat as CH


def test_a_batch_function_is_given_few_rows_at_a_time(spark):
    def sizes(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"id": pdf["id"], "n": len(pdf)})
    rows = CH.map_batches(spark.range(3000, numPartitions=1), sizes, "id long, n long").collect()
    assert sorted(r.id for r in rows) == list(range(3000)) and max(r.n for r in rows) <= 256
