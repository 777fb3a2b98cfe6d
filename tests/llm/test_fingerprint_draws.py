"""The likeness that the registered query gives, against the true similarity."""

import numpy as np

from millrace.llm import fingerprints, queries
from tests.llm.test_fingerprints import jaccard, plain

SF = "/root/testdata/sf0.001"


def test_error_of_the_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got, text = queries.Q["op10_fingerprints"](spark, SF).collect(), dict(rows)
    assert len(got) == len(rows) and all(len(r.fingerprint) == 8 * fingerprints.SAMPLES for r in got)
    truth = {i: (jaccard(text[i], e), jaccard(text[i], following)) for i, _, e, following in plain(rows)}
    for pairs in ([(r.near_edited, truth[r.doc_id][0]) for r in got], [(r.near_next, truth[r.doc_id][1]) for r in got]):
        error = np.array([a - b for a, b in pairs])
        print("RMS", np.sqrt((error**2).mean()), "mean", error.mean())
        assert abs(error.mean()) < 0.02 and np.sqrt((error**2).mean()) < 0.08
