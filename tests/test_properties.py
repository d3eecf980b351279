"""Property tests: text helpers against their Python definitions."""

import re

from hypothesis import given, settings, strategies as st

from pagelane.functions import text as T

TEXT = st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=40)


def _spark_values(spark, values, col_fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[1] for r in df.select("i", col_fn("t")).orderBy("i").collect()]


@settings(max_examples=5, deadline=None)
@given(st.lists(TEXT, min_size=20, max_size=60))
def test_strip_sanitize_like_python(spark, values):
    assert _spark_values(spark, values, T.py_strip) == [v.strip() for v in values]
    clean = [re.sub(r"[^\x20-\x7E]", "", v[:10]) for v in values]
    assert _spark_values(spark, values, lambda c: T.sanitize_text(c, 10)) == clean


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab.xé ", max_size=8), min_size=20, max_size=60))
def test_output_name_like_pathlib(spark, values):
    from pathlib import PurePosixPath
    names = [v for v in values if v and "/" not in v and v.strip(".") != "" and v not in (".", "..")]
    if not names:
        return
    want = [PurePosixPath(n).stem + ".md" for n in names]
    assert _spark_values(spark, names, T.output_name) == want


@settings(max_examples=5, deadline=None)
@given(st.lists(TEXT, min_size=20, max_size=60))
def test_fence_strip_like_python(spark, values):
    def py(t):
        t = t.strip()
        if t.startswith("```json"):
            t = t[7:]
        if t.endswith("```"):
            t = t[:-3]
        return t.strip()
    vals = [("```json" + v + "```") if i % 3 == 0 else v for i, v in enumerate(values)]
    assert _spark_values(spark, vals, T.strip_fence) == [py(v) for v in vals]
