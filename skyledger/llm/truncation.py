"""Texts cut off by a field limit or a broken transfer.

Method: per source a right-censored length distribution is fitted by maximum likelihood (a
piecewise-constant hazard over the histogram of lengths, the share of censored values at each
candidate limit by expectation-maximisation); each value at a candidate limit gets the posterior
of having been censored, and that is combined with the evidence of its ending. The evidence is a
likelihood ratio: how whole texts of the source end, against how they would end if cut at a
random place, which the texts themselves show.

What is gathered from the corpus are histograms: lengths per source, endings per source. Texts
never move; only a few features of each do.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm.mixing import source_name
from skyledger.llm.tokens import unique_documents
from skyledger.session import ensure_checkpoint_dir

#: Stands for documents without a source: they are judged by the endings of all documents.
ALL = "~all"
BROKEN = "\ufffd"
#: Fixed value: the characters that Unicode calls white space.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


@dataclass(frozen=True)
class CutParams:
    cuts: int = 3  # places at which each text is cut to learn how cut texts end
    least_at_limit: int = 5  # documents at a candidate limit, at least
    excess: float = 4.0  # and this many times what its neighbourhood lets expect
    tail_chars: int = 96  # the end of a text that holds its last word
    salts: int = 16
    threshold: float = 0.4  # of the posterior; texts away from a limit get too low a one rather than too high


def _blank(char: Column) -> Column:
    return (char != "") & F.contains(F.lit(BLANKS), char)


def _tail(text: Column, p: CutParams, at: Column | None = None) -> Column:
    """The last characters of a text (cut behind character `at`) without the blanks behind it, however many they are."""
    n = F.length(text) if at is None else at
    cut = text if at is None else F.substring(text, F.lit(1), n)
    plain = F.substring(text, F.greatest(n - (p.tail_chars - 1), F.lit(1)), F.least(n, F.lit(p.tail_chars)))
    return F.when(_blank(F.substring(text, n, F.lit(1))), F.right(F.rtrim(cut, F.lit(BLANKS)), F.lit(p.tail_chars))).otherwise(plain)


def _ending(tail: Column, blank_behind: Column) -> tuple[Column, Column]:
    """(word, kind) of the end of a text, given as its tail: its last word, generalised, and the kind of its last character."""
    word = F.lower(F.regexp_extract(F.substring_index(tail, " ", -1), r"(?U)(\S+)$", 1))
    word = F.when(F.length(word) > 24, F.right(word, F.lit(2))).otherwise(word)
    word = F.regexp_replace(word, r"\d", "0")
    word = F.when(word.rlike(r"^[0-9a-z]*0[a-z][0-9a-z]*$|^[a-z]+0[0-9a-z]*$|^(?=.*[a-f])[0a-f]{4,}$"), F.lit("<mixed>")).otherwise(word)
    last = F.right(tail, F.lit(1))
    # whole texts rarely end in blanks; a cut just behind a word or sentence often does
    blank = F.when(blank_behind, "_").otherwise("")
    kind = (
        F.when(F.length(tail) == 0, "blank")
        .when(tail.endswith("…") | tail.endswith("..."), "dots")
        .when(F.right(tail, F.lit(2)).rlike(r"\p{N}[.]$"), "numstop")
        .when(last.rlike(r"[.!?。！？।؟]"), F.concat(F.lit("stop"), last, blank))
        .when(last.rlike(r"\p{L}|\p{M}"), "letter")
        .when(last.rlike(r"\p{N}"), "digit")
        .when(last.rlike(r"[\p{P}`<>|=+]"), F.concat(F.lit("mark"), last, blank))
        .otherwise("symbol")
    )
    return word, kind


def _category(kind: Column, seen: Column) -> Column:
    """What the last character is and, where it may be the middle of a word or number, whether that ends another text."""
    new = F.when(seen > 0, ":known").otherwise(":new")
    return F.concat(kind, F.when(kind.isin("letter", "digit", "numstop"), new).otherwise(F.lit("")))


def features(documents: DataFrame, p: CutParams) -> DataFrame:
    """A row per document with a text: source, length in characters and bytes, how it ends, how cuts of it would end."""
    src = source_name(F.col("source"))
    d = unique_documents(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source")).where("doc_id is not null"))
    d = d.where("text is not null and text <> ''").withColumn("src", F.when(src != "", src).otherwise(F.lit(None)))
    d = d.withColumn("src", F.coalesce("src", F.lit(ALL)))
    text, n = F.col("text"), F.length("text")
    at = {f"at{i}": 1 + F.pmod(F.xxhash64("doc_id", F.lit(i)), F.greatest(n - 1, F.lit(1))).cast("int") for i in range(p.cuts)}
    d = d.withColumns(at)
    # each tail is made once; what follows reads a hundred characters instead of the text
    d = d.withColumns({"tail": _tail(text, p), "behind": _blank(F.right(text, F.lit(1)))} | {f"tail{i}": _tail(text, p, F.col(f"at{i}")) for i in range(p.cuts)} | {f"behind{i}": _blank(F.substring(text, F.col(f"at{i}"), F.lit(1))) for i in range(p.cuts)})
    word, kind = _ending(F.col("tail"), F.col("behind"))
    broken = F.col("tail").endswith(BROKEN)
    ends = [_ending(F.col(f"tail{i}"), F.col(f"behind{i}")) for i in range(p.cuts)]
    cuts = [F.struct(w.alias("word"), k.alias("kind")) for w, k in ends]
    return d.select(
        "doc_id",
        "src",
        n.alias("n"),
        (F.octet_length("text") - F.when(broken, 3).otherwise(0)).alias("b"),
        (F.octet_length("text") - F.when(broken, 3).otherwise(0) > n - F.when(broken, 1).otherwise(0)).alias("wide"),
        broken.alias("broken"),
        F.xxhash64("text").alias("h"),
        word.alias("word"),
        kind.alias("kind"),
        F.array(*cuts).alias("cuts"),
    )


def fit_limits(hist: pd.DataFrame, p: CutParams = CutParams()) -> pd.DataFrame:
    """Candidate limits of one source from its histogram (unit, len, n), with the censoring posterior at each.

    A candidate holds far more values than its neighbourhood. The length distribution is
    right-censored there; its maximum likelihood under a piecewise-constant hazard is deaths over
    exposure per piece, and the expected share of censored values at a candidate is what is left
    of its count after hazard times values at risk. Both are iterated to a fixed point.
    """
    out = []
    for unit, h in hist.groupby("unit"):
        h = h.groupby("len")["n"].sum().sort_index()
        x, c = h.index.to_numpy(np.int64), h.to_numpy(float)
        before = np.concatenate([[0.0], np.cumsum(c)])
        cand = []
        for i in np.flatnonzero(c >= p.least_at_limit):
            lo, hi = np.searchsorted(x, int(x[i] / 1.3)), np.searchsorted(x, int(x[i] * 1.3) + 1)
            span = max(1, int(x[i] * 1.3) - int(x[i] / 1.3))
            others = np.sort(c[lo:hi])[: -1 - min(2, (hi - lo) // 8)] if hi - lo > 1 else np.zeros(0)
            mean = max(others.sum(), 0.5) / span
            # Poisson tail: so many by chance at one of all lengths
            if c[i] >= p.excess * mean and c[i] * math.log(c[i] / mean) - c[i] + mean > math.log(len(x) + 1) + 7:
                cand.append(i)
        if not cand:
            continue
        post = {i: 1.0 for i in cand}
        edges = [0]
        while edges[-1] <= x[-1]:
            edges.append(max(edges[-1] + 8, int(edges[-1] * 1.15)))
        piece = np.searchsorted(edges, x, side="right") - 1
        at_risk = before[-1] - before[:-1]
        for _ in range(20):
            deaths = c.copy()
            for i, w in post.items():
                deaths[i] *= 1 - w
            d = np.bincount(piece, deaths, len(edges))
            risk = np.bincount(piece, at_risk * np.diff(np.concatenate([[x[0] - 1], x])), len(edges))
            hazard = np.divide(d, np.maximum(risk, 1e-9))
            new = {i: float(np.clip(1 - hazard[piece[i]] * at_risk[i] / c[i], 0.0, 1.0)) for i in cand}
            done = max(abs(new[i] - post[i]) for i in cand) < 1e-6
            post = new
            if done:
                break
        out += [(unit, int(x[i]), float(c[i]), post[i]) for i in cand if post[i] > 0.5]
    r = pd.DataFrame(out, columns=["unit", "lim", "n", "prior"])
    # One limit shows in both units wherever texts are plain ASCII: the unit that explains more keeps it.
    drop = set()
    for i, a in r[r.unit == "bytes"].iterrows():
        for j, b in r[r.unit == "chars"].iterrows():
            if b.lim <= a.lim <= b.lim * 1.06 + 3:
                drop.add(j if a.n > b.n else i)
    return r.drop(index=list(drop))


def fit_endings(cats: pd.DataFrame) -> pd.DataFrame:
    """Likelihood ratios of the ending categories of one source, its rate of cuts, and that at each limit.

    `cats` has (grp, cat, n) where grp is "seen" (texts not at a limit), "cut" (random cuts), a limit,
    "all_seen"/"all_cut" for the shares over all sources, or "twice" for the number of endings seen twice. Texts that aren't at a limit are a mixture
    of whole and cut ones; no category of the whole ones can be negative, and the categories that
    cut texts have most in excess give the share of cut ones. The share at each limit is found by expectation-maximisation.
    """
    t = cats.pivot_table(index="cat", columns="grp", values="n", aggfunc="sum", fill_value=0.0)
    for g in ("seen", "cut", "all_seen", "all_cut", "twice"):
        if g not in t:
            t[g] = 0.0

    def smooth(own: pd.Series, prior: pd.Series, weight: float) -> pd.Series:
        prior = (prior + 0.2) / (prior.sum() + 0.2 * len(prior))
        return (own + weight * prior) / (own.sum() + weight)

    cut = smooth(t["cut"], t["all_cut"], 20.0)
    seen = smooth(t["seen"], t["all_seen"], 3.0)
    def cut_share(a: pd.Series, b: pd.Series) -> float:
        # pooled over the endings that whole texts have least of, as a single one may be missing by chance
        order = (a / b).sort_values().index
        low = order[: 1 + int(np.searchsorted(b[order].cumsum().to_numpy(), 0.4))]
        return float(np.clip(a[low].sum() / b[low].sum(), 0.002, 0.95))

    # With few texts, an unseen ending may just be a rare one of whole texts. How many of those to expect follows
    # from the endings seen twice: if whole texts hardly vary there are none, and unseen ones are cuts.
    n_seen = max(float(t["seen"].sum()), 1.0)
    new = [k for k in t.index if k.endswith(":new")]
    rare = (3.0 * float(t["twice"].sum()) + 1.0) / n_seen
    by_novelty = float(np.clip((seen[new].sum() - rare) / max(cut[new].sum(), 0.05), 0.002, 0.95))
    base = (cut_share(seen, cut) * n_seen + by_novelty * 50.0) / (n_seen + 50.0)
    whole = (seen - base * cut).clip(lower=0.02 * seen).clip(lower=1e-5)
    whole = whole / whole.sum()
    ratio = cut / whole
    rows = [("", k, float(ratio[k]), base) for k in t.index]
    for g in t.columns:
        if not g.startswith("limit:"):
            continue
        n = t[g]
        prior = float(g.split(":")[3])
        q = prior
        for _ in range(50):
            post = q * ratio / (q * ratio + 1 - q)
            # the length's posterior weighs in like two documents
            new = float(np.clip(((post * n).sum() + 2 * prior) / (n.sum() + 2), 0.01, 0.995))
            if abs(new - q) < 1e-6:
                break
            q = new
        rows += [(g, k, float(ratio[k]), q) for k in t.index]
    return pd.DataFrame(rows, columns=["grp", "cat", "ratio", "share"])


def scored_documents(documents: DataFrame, params: CutParams = CutParams()) -> DataFrame:
    """(doc_id, src, n, at_limit, broken, posterior, cut) of every document with a text.

    Documents with a null or empty text aren't cut. A document without a source is judged by the
    endings and the limits of all documents. Repeated doc_ids count once; equal texts
    are judged alike. Blank texts end in nothing and are whole unless at a limit. Texts of any length
    count whole. An empty table gives no rows.
    """
    p = params
    ensure_checkpoint_dir(documents.sparkSession)
    f = features(documents, p).checkpoint()  # read several times below; the texts only once
    sizes = f.select("src", F.inline(F.array(F.struct(F.lit("chars").alias("unit"), F.col("n").alias("len")), F.struct(F.lit("bytes").alias("unit"), F.col("b").alias("len")))))
    hist = sizes.groupBy("src", "unit", "len").agg(F.count(F.lit(1)).alias("n"))
    # documents without a source may come from any: their limits are those of all documents
    hist = hist.where(F.col("src") != ALL).unionByName(hist.groupBy("unit", "len").agg(F.sum("n").alias("n")).select(F.lit(ALL).alias("src"), "unit", "len", "n"))

    def limits_of(key: tuple, h: pd.DataFrame) -> pd.DataFrame:
        r = fit_limits(h, p)
        r["src"] = key[0]
        return r[["src", "unit", "lim", "prior"]]

    limits = hist.groupBy("src").applyInPandas(limits_of, "src string, unit string, lim long, prior double")
    per_src = limits.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("unit", "lim", "prior"))).alias("limits"))

    def salted(small: DataFrame) -> DataFrame:
        return small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(p.salts - 1))))

    # a source may hold a third of all documents: its one row meets them under several salts
    x = f.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(99)), F.lit(p.salts)).cast("int")).join(salted(per_src), ["src", "salt"], "left")
    at = F.filter(
        F.coalesce("limits", F.array().cast("array<struct<unit:string,lim:bigint,prior:double>>")),
        lambda m: F.when(m["unit"] == "chars", F.col("n") == m["lim"]).otherwise((F.col("b") == m["lim"]) | (F.col("wide") & (F.col("b") > m["lim"] - 4) & (F.col("b") < m["lim"]))),
    )
    m = F.try_element_at(at, F.lit(1))
    grp = F.when(m.isNotNull(), F.concat_ws(":", F.lit("limit"), m["unit"], m["lim"].cast("string"), F.round(m["prior"], 4).cast("string"))).otherwise("")
    x = x.withColumn("grp", grp).drop("limits")

    # how often a word ends a text that isn't at a limit, and a random cut
    # (a text that is there several times is one)
    words = x.where("grp = ''").select("src", "word", "kind", "h").distinct().select("src", "word", "kind", F.lit(1).alias("seen"), F.lit(0).alias("cut"))
    words = words.unionByName(f.select("src", F.inline("cuts")).select("src", "word", "kind", F.lit(0).alias("seen"), F.lit(1).alias("cut")))
    own = words.groupBy("src", "word").agg(F.sum("seen").alias("seen"), F.sum("cut").alias("cut"), F.max("kind").alias("w_kind"))
    pooled = own.groupBy("word").agg(F.sum("seen").alias("seen"), F.sum("cut").alias("cut"), F.max("w_kind").alias("w_kind")).withColumn("src", F.lit(ALL))
    stats = own.where(F.col("src") != ALL).unionByName(pooled)
    stats = stats.withColumns({"all_seen": F.col("seen"), "all_cut": F.col("cut")}).drop("seen", "cut").checkpoint()
    totals = stats.groupBy("src").agg(F.sum("all_seen").alias("n_seen"), F.sum("all_cut").alias("n_cut"))

    # Words that make up a thousandth of all endings are few by arithmetic and go to every executor; the others
    # have no hot key. Documents with one of the former get a filler key of their own in the second join.
    many = (1 + p.cuts) * f.count() / 1000.0
    often = F.col("all_seen") + F.col("all_cut") >= many
    hot = stats.where(often).drop("w_kind")
    cold = stats.where(~often).select(F.col("src").alias("c_src"), F.col("word").alias("c_word"), F.col("all_seen").alias("c_seen"), F.col("all_cut").alias("c_cut"))
    y = x.join(F.broadcast(hot), ["src", "word"], "left")
    filler = F.when(F.col("all_seen").isNull(), F.col("word")).otherwise(F.concat(F.lit("~"), F.col("doc_id").cast("string")))
    y = y.withColumn("key", filler).join(cold, (F.col("src") == F.col("c_src")) & (F.col("key") == F.col("c_word")), "left")
    y = y.withColumns({"all_seen": F.coalesce("all_seen", "c_seen", F.lit(0)), "all_cut": F.coalesce("all_cut", "c_cut", F.lit(0))})
    others = F.col("all_seen") - (F.col("grp") == "").cast("int")  # the document itself left out
    y = y.withColumns({"others": others, "cat": _category(F.col("kind"), others)})
    y = y.select("doc_id", "src", "n", "broken", "grp", "cat", "kind", "others", "all_cut", "salt").checkpoint()

    # categories per source: small tables from here on
    cut_words = f.select("doc_id", "src", F.inline("cuts")).groupBy("src", "word", "kind").agg(F.count(F.lit(1)).alias("k"))
    cut_cats = cut_words.join(stats.select("src", "word", "all_seen"), ["src", "word"], "left").withColumn("cat", _category(F.col("kind"), F.coalesce("all_seen", F.lit(0))))
    cut_cats = cut_cats.groupBy("src", "cat").agg(F.sum("k").alias("n")).withColumn("grp", F.lit("cut"))
    seen_cats = y.groupBy("src", "grp", "cat").agg(F.count(F.lit(1)).alias("n")).withColumn("grp", F.when(F.col("grp") == "", "seen").otherwise(F.col("grp")))
    twice = stats.where((F.col("all_seen") == 2) & F.col("w_kind").isin("letter", "digit", "numstop")).groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    cats = seen_cats.unionByName(cut_cats).unionByName(twice.select("src", F.lit("twice").alias("grp"), F.lit("letter:new").alias("cat"), "n"))
    overall = cats.where("grp in ('seen', 'cut')").groupBy("grp", "cat").agg(F.sum("n").alias("n")).withColumn("grp", F.concat(F.lit("all_"), F.col("grp")))
    overall = overall.agg(F.collect_list(F.struct("grp", "cat", "n")).alias("all"))  # one row, of an entry for each kind of ending
    sources = cats.select("src").distinct()
    cats = cats.unionByName(sources.crossJoin(F.broadcast(overall)).select("src", F.inline("all")))

    def endings_of(key: tuple, c: pd.DataFrame) -> pd.DataFrame:
        if key[0] == ALL:  # judged by all documents
            for g in ("seen", "cut"):
                c = c[c.grp != g] if (c.grp == "all_" + g).any() else c
                c = pd.concat([c, c[c.grp == "all_" + g].assign(grp=g)])
        r = fit_endings(c)
        r["src"] = key[0]
        return r[["src", "grp", "cat", "ratio", "share"]]

    fitted = cats.groupBy("src").applyInPandas(endings_of, "src string, grp string, cat string, ratio double, share double")
    z = y.join(salted(fitted), ["src", "grp", "cat", "salt"], "left").join(salted(totals), ["src", "salt"], "left")
    # A known word has its own ratio, by how often it ends texts and cuts; what cut texts add to the former is taken off.
    p_cut = (F.col("all_cut") + 0.5) / (F.col("n_cut") + 1.0)
    from_cuts = F.least(2 * F.col("share"), F.lit(0.3)) * F.col("n_seen") * p_cut
    own_whole = F.greatest(F.col("others") - from_cuts - F.sqrt(from_cuts), 0.1 * F.col("others")) / F.greatest(F.col("n_seen"), F.lit(1))
    ratio = F.when(F.col("others") > 0, F.when(F.col("kind").startswith("stop"), F.col("ratio")).otherwise(p_cut / F.greatest(own_whole, F.lit(1e-9)))).otherwise(F.col("ratio"))
    # dots are an author's own, or the mark of a cut at a limit: they say nothing beyond the length
    ratio = F.when(F.col("kind").isin("dots", "blank"), F.when(F.col("grp") == "", 0.0).when(F.col("kind") == "dots", 1.0).otherwise(F.col("ratio"))).otherwise(ratio)
    share = F.coalesce("share", F.lit(0.01))
    posterior = F.when(F.col("broken"), 1.0).otherwise(share * F.coalesce(ratio, F.lit(0.0)) / (share * F.coalesce(ratio, F.lit(0.0)) + 1 - share))
    return z.select("doc_id", "src", "n", (F.col("grp") != "").alias("at_limit"), "broken", posterior.alias("posterior"), (posterior > p.threshold).alias("cut"))


def cut_documents(documents: DataFrame, params: CutParams = CutParams()) -> DataFrame:
    """(doc_id) of the documents whose stored text is only the beginning of what was written."""
    return scored_documents(documents, params).where("cut").select("doc_id")


def cut_rates(documents: DataFrame, params: CutParams = CutParams()) -> DataFrame:
    """How often each source truncates: documents with a text, cut ones, those at a limit, and the rate."""
    s = scored_documents(documents, params)
    n, k = F.count(F.lit(1)), F.count(F.when(F.col("cut"), 1))
    r = s.groupBy("src").agg(n.alias("n_texts"), k.alias("n_cut"), F.count(F.when(F.col("cut") & F.col("at_limit"), 1)).alias("n_cut_at_limit"), (k / n).alias("cut_rate"))
    return r.select(F.when(F.col("src") != ALL, F.col("src")).alias("source"), "n_texts", "n_cut", "n_cut_at_limit", "cut_rate")
