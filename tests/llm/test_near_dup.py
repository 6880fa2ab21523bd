"""Near duplicates: null and repeated ids, and buckets whose members stay apart."""

import numpy as np
from brute import near_components

from loomwork.llm import near_dup


def test_null_and_repeated_ids_bring_only_their_own_text(spark, monkeypatch):
    """400 texts without an id and 400 of one id: each is read once, not once for each other one."""
    made, written = [], near_dup.written

    def counted(df, name, **options):
        out = written(df, name, **options)
        if name == "near-dup-texts":
            made.append(out.count())
        return out

    monkeypatch.setattr(near_dup, "written", counted)
    text = lambda n: " ".join(f"w{n // 2}x{i}" for i in range(40)) + f" end{n}"  # noqa: E731  pairs are alike
    rows = [(None if n < 400 else 7, text(n)) for n in range(800)] + [(None, text(0))] * 20
    out = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()
    assert len(out) == 820 and sum(made) <= 2 * 800
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in out} == {(None, None, True), (7, 7, True)}


def test_members_of_a_bucket_that_stay_apart(spark):
    """A frame that all share, so that many share buckets, and own words: pairs on either side of 0.8."""
    rng = np.random.default_rng(2)
    frame = [f"f{i}" for i in range(70)]
    rows = []
    for i in range(90):
        own = [f"o{i // 3}x{j}" for j in range(rng.integers(2, 24))]
        rows.append((i, " ".join(frame + own + [f"z{i}"])))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=2, block=4).collect()}
    assert got == near_components(dict(rows), 2) and len({c for _, c in got.values()}) > 1
