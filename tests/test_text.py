"""Normal forms against Python's own."""

import sys
import unicodedata

from pyspark.sql import functions as F

from quillspark.functions import text as t
from quillspark.operators import duplicates


def test_decompose_like_unicodedata(spark):
    known = [chr(i) for i in range(sys.maxunicode + 1) if unicodedata.category(chr(i)) not in ("Cn", "Cs")]
    texts = ["", "plain", None, "ẹ́ x", "ẛ̣ ﬁ Å", *("".join(known[i : i + 50]) for i in range(0, len(known), 50)), *(f"a{x}b" for x in known[128:3000])]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").select("i", t.decompose(F.col("x")).alias("y")).collect()
    assert {r.i: r.y for r in got} == {i: None if x is None else unicodedata.normalize("NFKD", x) for i, x in enumerate(texts)}


def test_keys_need_no_python_worker(spark):
    """What Python workers held grew with the batches of texts that they got."""
    rows = spark.createDataFrame([(0, "1", "É", "é", 2000, "10.1/A", ["x"])], "idx long, pmid string, title string, abstract string, publication_year int, doi string, publication_types array<string>")
    keyed = duplicates.keyed(rows)
    assert "Python" not in keyed._jdf.queryExecution().optimizedPlan().toString() and keyed.first().nabstract == "é"
