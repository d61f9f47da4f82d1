import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skyledger.llm.bpe import BytePairEncoder, PerfectHash, encoder, vocabulary_path
from skyledger.llm.mixing import mixture, rates, reached_shares
from skyledger.llm.nearest import matched_frames
from skyledger.llm.tokens import token_counts, token_ids
from skyledger.llm.truncation import cut_documents, cut_rates, fit_limits, scored_documents

DOCS = "doc_id long, text string, source string, extra int"


def reference(text):
    import base64

    import tiktoken

    with open(vocabulary_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    from skyledger.llm.bpe import PATTERN

    if not hasattr(reference, "enc"):
        reference.enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return reference.enc.encode_ordinary(text)


def test_perfect_hash_is_minimal_and_exact():
    keys = [str(i).encode() for i in range(5000)]
    h = PerfectHash(keys)
    assert sorted(h.slot(k) for k in keys) == list(range(5000))
    assert all(h.slot(f"x{i}".encode()) == -1 for i in range(2000))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_encoding_equals_the_public_library(text):
    assert encoder(vocabulary_path()).encode(text) == reference(text)


@pytest.mark.parametrize("text", ["", None, "<|endoftext|>", "　 \r\n\t", "a" * 5000, "🛰️👍", " don't  stop ", "x" * 3 + "\u0000"])
def test_encoding_edges(text):
    assert encoder(vocabulary_path()).encode(text) == (reference(text) if text else [])


def test_round_trip_of_ids():
    e: BytePairEncoder = encoder(vocabulary_path())
    by_id = dict(zip(e.ids, e.hash.keys, strict=True))
    text = "Sortie 101: høyde 54.6 m, 高度117メートル"
    assert b"".join(by_id[i] for i in e.encode(text)).decode() == text


def test_token_ids_table(spark):
    df = spark.createDataFrame([(1, "Hello world", "a", 0), (1, "Hello world", "a", 0), (2, None, "a", 0), (3, "", None, 0), (None, "x", "a", 0)], DOCS)
    got = {r.doc_id: list(r.ids) for r in token_ids(df).collect()}
    assert got == {1: reference("Hello world"), 2: [], 3: []}
    assert token_ids(df.limit(0)).count() == 0
    assert {r.doc_id: r.n_tokens for r in token_counts(df).collect()} == {1: 2, 2: 0, 3: 0}


def sized(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")


def test_mixture_shares_and_caps(spark):
    rows = [(i, "big", 10) for i in range(4000)] + [(10_000 + i, "small", 10) for i in range(100)]
    t = spark.createDataFrame([(" BIG ", 0.8, 1), ("small", 0.2, 3), ("none", 0.0, 4), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    s = sized(spark, rows)
    r = {x.source: x for x in rates(s, t, "shrink").collect()}
    assert r["small"].rate == pytest.approx(3.0) and r["big"].rate == pytest.approx(0.3) and r["none"].rate == 0
    rep = {x.source: x for x in reached_shares(s, t, short="shrink").collect()}
    assert rep["small"].reached_share == pytest.approx(0.2, abs=0.02) and rep["small"].most_copies == 3 and rep["small"].at_cap
    m = mixture(s, t, short="shrink").toPandas()
    assert m.duplicated(["doc_id", "copy_no"]).sum() == 0 and m.groupby("doc_id").copy_no.max().max() == 3
    assert mixture(s, t, short="shrink").count() == len(m)  # the seed decides, not the run
    full = {x.source: x.rate for x in rates(s, t).collect()}
    assert full["small"] == 3.0 and full["big"] == pytest.approx(0.82)


def test_scarce_and_missing_sources_hold_nobody_back(spark):
    """A source at its cap falls short and says so; the share of one without documents goes to the others in proportion."""
    rows = [(i, "a", 10) for i in range(6000)] + [(10_000 + i, "b", 10) for i in range(3000)] + [(20_000 + i, "rare", 10) for i in range(10)]
    t = spark.createDataFrame([("a", 0.4, 2), ("b", 0.2, 2), ("rare", 0.2, 3), ("missing", 0.2, 9)], "source string, target_share double, max_repeats int")
    rep = {x.source: x for x in reached_shares(sized(spark, rows), t).collect()}
    assert rep["a"].due_share == pytest.approx(0.5) and rep["missing"].due_share == 0 and rep["missing"].n_emitted == 0
    assert rep["rare"].at_cap and rep["rare"].n_emitted == 30 and rep["rare"].reached_share < rep["rare"].due_share
    assert rep["a"].emitted_tokens / rep["b"].emitted_tokens == pytest.approx(2.0, rel=0.1) and rep["a"].emitted_tokens == pytest.approx(0.5 * 90_100, rel=0.1)


def test_mixed_texts_are_the_copies_of_the_mixture(spark):
    from skyledger.llm.mixing import mixed_documents, sized_documents

    df = spark.createDataFrame([(i, "word " * (i % 7), " A " if i % 3 else "b", 0) for i in range(300)] + [(0, "", "b", 0), (400, "x", None, 0), (None, "x", "a", 0)], DOCS)
    t = spark.createDataFrame([("a", 0.3, 2), ("b", 0.7, 2)], "source string, target_share double, max_repeats int")
    s = sized_documents(df)
    texts = {(r.doc_id, r.copy_no): r.text for r in mixed_documents(df, s, t).collect()}
    assert set(texts) == {(r.doc_id, r.copy_no) for r in mixture(s, t).collect()} and texts[3, 1] == "word word word "


def test_unrepeated_texts_do_not_move(spark):
    """One repeated id settles its own rows; the texts of the others meet no exchange."""
    from skyledger.llm.tokens import unique_documents

    df = spark.createDataFrame([(i, f"text {i}") for i in range(500)] + [(7, "a text"), (7, "a text"), (None, "n"), (None, "m")], "doc_id long, text string")
    got = [tuple(r) for r in unique_documents(df.where("doc_id is not null")).collect()]
    assert len(got) == 500 and dict(got)[7] == "a text" and dict(got)[8] == "text 8"
    plan = unique_documents(df.where("doc_id is not null"))._jdf.queryExecution().executedPlan().toString()
    above = plan.split("Union")[1]
    once = above[: above.index("SortAggregate")] if "SortAggregate" in above else above
    assert "BroadcastHashJoin" in once and "hashpartitioning" not in once.split("BroadcastExchange")[0]


def test_mixture_of_nothing(spark):
    t = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    assert mixture(sized(spark, []), t).count() == 0
    assert reached_shares(sized(spark, [(1, "a", 0)]), t).first().reached_share == 0.0


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(3)
    tel = pd.DataFrame({"flight_id": rng.choice(["a", "b", "c"], 3000), "t_sec": rng.uniform(0, 1000, 3000).round(3)}).drop_duplicates(["flight_id", "t_sec"])
    tel["seq"] = range(len(tel))
    tel["format_detected"] = tel.flight_id.map({"a": "A", "b": "B", "c": None})
    tel.loc[::50, "t_sec"] = None
    fr = pd.DataFrame({"flight_id": rng.choice(["a", "b", "c", "d"], 400), "idx": range(400), "t": rng.uniform(-2, 1002, 400)})
    tol = {"A": 0.15, "B": 0.6}
    want = set()
    for f in fr.itertuples():
        x = tel[(tel.flight_id == f.flight_id) & tel.t_sec.notna()]
        lim = tol.get(x.format_detected.iloc[0]) if len(x) else None
        if lim is not None:
            d = (x.t_sec - f.t).abs()
            if d.min() <= lim:
                want.add((f.flight_id, f.idx, "telemetry", x.seq[d.idxmin()]))
    sch = "flight_id string, seq long, t_sec double, format_detected string"
    tdf = spark.createDataFrame([(r.flight_id, r.seq, None if math.isnan(r.t_sec) else r.t_sec, r.format_detected) for r in tel.itertuples()], sch)
    tdf = tdf.union(tdf.limit(500))
    fdf = spark.createDataFrame(fr).union(spark.createDataFrame([("a", None, 1.0), ("a", 999, None), (None, 998, 1.0)], "flight_id string, idx long, t double"))
    fdf = fdf.union(fdf)
    pose = spark.createDataFrame([], "flight_id string, pose_no long, t double")
    fmt = spark.createDataFrame([("A", 0.15), ("B", 0.6)], "format_detected string, match_tol_s double")
    got = [tuple(r) for r in matched_frames(fdf, tdf, pose, fmt).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert matched_frames(fdf.limit(0), tdf, pose, fmt).count() == 0


def test_limits_are_found_and_smooth_lengths_are_not():
    rng = np.random.default_rng(0)
    n = np.minimum(rng.lognormal(5.5, 0.6, 5000).astype(int) + 1, 280)
    h = pd.Series(n).value_counts()
    r = fit_limits(pd.DataFrame({"unit": "chars", "len": h.index, "n": h.to_numpy()}))
    assert r.lim.tolist() == [280] and r.prior.iloc[0] > 0.95
    h = pd.Series(rng.lognormal(5.5, 0.6, 5000).astype(int) + 1).value_counts()
    assert fit_limits(pd.DataFrame({"unit": "chars", "len": h.index, "n": h.to_numpy()})).empty


def test_cut_documents_on_a_planted_corpus(spark):
    rng = np.random.default_rng(1)
    words = ["mesh", "voxel", "track", "gimbal", "depth", "frame", "overlap", "baseline", "propeller", "coverage"]
    rows, cut = [], set()
    for i in range(1500):
        text = ""
        while len(text) < rng.integers(60, 500):
            text += (" " if text else "") + " ".join(rng.choice(words, rng.integers(4, 9))).capitalize() + "."
        if len(text) > 280:
            text = text[:280]
            if not text.endswith("."):
                cut.add(i)
        elif rng.random() < 0.03:
            text = text[: int(rng.integers(20, len(text) - 5))]
            if not text.endswith("."):
                cut.add(i)
        rows.append((i, text, " Note ", 0))
    rows += [(5000, None, "note", 0), (5001, "", "note", 0), (5002, "   ", "note", 0), (5003, "Nothing moved fo�", None, 0), (0, rows[0][1], " Note ", 0)]
    df = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id for r in cut_documents(df).collect()}
    assert 5003 in got and not {5000, 5001, 5002} & got
    got -= {5003}
    assert len(got & cut) / len(cut) > 0.9 and len(got & cut) / len(got) > 0.95
    r = {x.source: x for x in cut_rates(df).collect()}
    assert r["note"].n_cut == len(got)


def test_blanks_behind_the_end_change_nothing_however_many(spark):
    from pyspark.sql import functions as F

    from skyledger.llm.truncation import CutParams, _blank, _ending, _tail

    df = spark.createDataFrame([("The flight was calm" + " " * 5,), ("The flight was calm" + " \t\u3000" * 400,), (" " * 500,), ("x" * 300_000 + " " * 90,)], "text string")
    w, k = _ending(_tail(F.col("text"), CutParams()), _blank(F.right("text", F.lit(1))))
    got = [tuple(r) for r in df.select(w, k).collect()]
    assert got[0] == got[1] == ("calm", "letter") and got[2][1] == "blank" and got[3] == ("xx", "letter")


def test_a_source_that_cuts_most_of_its_texts_is_not_reported_as_half(spark):
    rng = np.random.default_rng(2)
    words = ["mesh", "voxel", "track", "gimbal", "depth", "frame", "overlap", "baseline", "propeller", "coverage"]
    whole = lambda: " ".join((" ".join(rng.choice(words, rng.integers(4, 9))).capitalize() + ".") for _ in range(rng.integers(3, 9)))
    rows = [(i, whole(), "good", 0) for i in range(1500)]
    for i in range(1500):
        t = whole()
        rows.append((5000 + i, t[: int(rng.integers(15, len(t) - 3))] if i % 10 < 8 else t, "bad", 0))
    r = {x.source: x.cut_rate for x in cut_rates(spark.createDataFrame(rows, DOCS)).collect()}
    assert r["good"] < 0.05 and r["bad"] > 0.65


def test_cut_documents_of_nothing(spark):
    assert scored_documents(spark.createDataFrame([], DOCS)).count() == 0
