"""Schemas that drift between the files of one source.

Method: every file gets a versioned fingerprint of its schema (the sorted fields with their
types); consecutive fingerprints of a source are compared, and each difference becomes an
explicit migration step (added, removed, renamed, retyped). The renames chain into rules (key to
column, cast); every file is routed through the rules of its own fingerprint into one table, and
every change is recorded.

No list of spellings is built in. That a key which goes and a key which comes are one quantity is
concluded from evidence:

* their values in the two files (ranges that meet, shared texts, both flags), pooled over all
  steps of the corpus in which the one gives way to the other;
* that no file of the corpus holds both, against how many would by chance;
* their names.

Keys, types and value profiles are aggregated per (file, key) with map-side combining before
anything is moved; a file's predecessor is found inside buckets of time, so no source is one task.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyledger.operators.blocks import meet_salted, previous_row
from skyledger.operators.graph import components
from skyledger.session import ensure_checkpoint_dir

c = F.col

#: The consistent table: the columns of the telemetry model and the optional camera fields, with their cast rule.
TARGET = {
    "t_sec": "clock",
    "lat": "number",
    "lon": "number",
    "height_m": "number",
    "yaw_deg": "number",
    "pitch_deg": "number",
    "roll_deg": "number",
    "is_video": "flag",
    "format_detected": "format",
    "focal_len_mm": "number",
    "battery_pct": "number",
    "satellites": "number",
    "iso": "number",
    "fnum": "number",
    "shutter_s": "number",
}
#: Strings that stand for "no value", and the names of the formats in the order of their codes.
PLACEHOLDERS = ["", "--", "n/a", "N/A", "null", "None", "nan", "NaN"]
FORMATS = ["A (TXTlogToCSVtool.exe)", "B (airdata.com)", "C (SRT subtitle)", "D (SRT FrameCnt telemetry)"]
KINDS = ["number", "boolean", "string", "array", "object"]
FLAG, NUMBER, TEXT = 1, 2, 4  # bits of the classes of values a key holds


@dataclass(frozen=True)
class DriftParams:
    threshold: float = 0.45  # of the score of a rename
    values: float = 0.65  # weight of how well the values meet (0 to 1)
    names: float = 0.45  # weight of how alike the names are (0 to 1)
    apart: float = 0.25  # weight of never standing in one file, where chance would have put them together
    together: float = 0.02  # share of the rarer key's files that may hold both by mistake
    pooled_steps: int = 3  # steps of the same exchange from which their mean speaks for each of them
    sketch_log_entries: int = 10  # file ids kept by the sketch of a key's files: exact up to 1,024
    salts: int = 16


def _kind(value: Column) -> Column:
    """The JSON type of a value, null for null."""
    name = F.substring(F.schema_of_variant(value), 1, 2)
    return F.when(name == "VO", None).when(name == "BO", "boolean").when(name == "ST", "string").when(name == "OB", "object").when(name == "AR", "array").otherwise("number")


def _number(text: Column) -> Column:
    """A number, also one with a short unit behind it, or a clock time in seconds. Patterns are tried only where a plain cast fails."""
    plain = F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*[^\d\s.,:]{0,4}\s*$", 1).try_cast("double")
    part = lambda i: F.regexp_extract(text, r"^(\d+):(\d{2}):(\d{2}(?:[.,]\d+)?)$", i)
    clock = part(1).try_cast("double") * 3600 + part(2).try_cast("double") * 60 + F.replace(part(3), F.lit(","), F.lit(".")).try_cast("double")
    return F.coalesce(text.try_cast("double"), F.when(F.contains(text, F.lit(":")), clock).otherwise(plain))


def _entries(records: DataFrame) -> DataFrame:
    """(file_id, rec_no, key, kind, v): a row per key of each payload that is a JSON object, with its value as a variant."""
    rows = records.select(c("file_id").cast("bigint").alias("file_id"), c("rec_no").cast("int").alias("rec_no"), "payload").where("file_id is not null and payload is not null")
    x = rows.select("file_id", "rec_no", F.explode(F.map_entries(F.from_json("payload", "map<string,variant>"))).alias("e"))
    return x.select("file_id", "rec_no", "e.key", _kind(c("e.value")).alias("kind"), c("e.value").alias("v"))


def _values(records: DataFrame) -> DataFrame:
    """The entries with their values as text; null values have a null text."""
    return _entries(records).withColumn("text", F.when(c("kind").isNotNull(), F.try_variant_get("v", "$", "string"))).drop("v")


def fingerprints(files: DataFrame, records: DataFrame) -> DataFrame:
    """One row per json file: its fields with types and value profiles, its fingerprint, its place in the source's history.

    The type of a field is that of most of its non-null values, ties going to number, boolean,
    string, array, object in this order, null if it has none. Repeated records count once. A file
    without a readable record has no fields. Payloads that aren't JSON objects give no field. A
    profile holds the range of the numbers, the classes of the values and two signatures of the texts;
    placeholders don't count in it.
    """
    # only texts are read as texts; numbers and flags come typed
    v = _entries(records).withColumn("text", F.when(~c("kind").isin("number", "boolean"), F.try_variant_get("v", "$", "string")))
    v = v.withColumn("text", F.when(~F.trim("text").isin(*PLACEHOLDERS), c("text")))
    num = F.when(c("kind") == "number", F.try_variant_get("v", "$", "double")).when(c("kind") == "boolean", F.try_variant_get("v", "$", "boolean").cast("double"))
    num = num.when(F.lower("text").isin("true", "false"), (F.lower("text") == "true").cast("double")).when(c("text").isNotNull(), _number(c("text")))
    v = v.withColumn("num", F.when(F.abs(num) < 1e300, num)).withColumn("said", c("num").isNotNull() | c("text").isNotNull())
    bit = lambda n: F.expr(f"shiftleft(1L, cast(pmod({n}, 64) as int))")
    v = v.withColumns(
        {
            "cls": F.when(~c("said"), 0).when(c("num").isin(0.0, 1.0), FLAG).when(c("num").isNotNull(), NUMBER).otherwise(TEXT),
            "sig": F.when(c("said") & c("num").isNull(), bit("xxhash64(text)")).otherwise(F.lit(0).cast("bigint")),
            "sig2": F.when(c("said") & c("num").isNull(), bit("hash(text)")).otherwise(F.lit(0).cast("bigint")),
            "lo": c("num"),
            "hi": c("num"),
            "part": F.floor(F.coalesce("rec_no", F.lit(-1)) / 64),
            "seen": bit("coalesce(rec_no, -1)"),
        }
    )
    profile = [F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.bit_or("cls").alias("cls"), F.bit_or("sig").alias("sig"), F.bit_or("sig2").alias("sig2")]
    # a bit per record number: repeats count once, and partial results combine before the exchange
    parts = v.groupBy("file_id", "key", "kind", "part").agg(F.bit_or("seen").alias("seen"), *profile)
    n_of = lambda k: F.coalesce(F.sum(F.when(c("kind") == k, F.bit_count("seen"))), F.lit(0)).alias(k)
    per_key = parts.groupBy("file_id", "key").agg(*[n_of(k) for k in KINDS], *profile)
    best = F.array_max(F.array(*[F.struct(c(k).alias("n"), F.lit(-i).alias("rank"), F.lit(k).alias("kind")) for i, k in enumerate(KINDS)]))
    field = F.struct("key", F.when(best["n"] > 0, best["kind"]).alias("kind"), "lo", "hi", "cls", "sig", "sig2")
    per_file = per_key.groupBy("file_id").agg(F.sort_array(F.collect_list(field)).alias("fields"))
    listed = files.where("file_kind = 'json' and file_id is not null").select(c("file_id").cast("bigint").alias("file_id"), "aircraft_id", "exported_at")
    listed = listed.groupBy("file_id").agg(F.min("aircraft_id").alias("aircraft_id"), F.min("exported_at").alias("exported_at"))
    out = listed.join(per_file, "file_id", "left")
    out = out.withColumn("fields", F.coalesce("fields", F.array().cast("array<struct<key:string,kind:string,lo:double,hi:double,cls:int,sig:bigint,sig2:bigint>>")))
    return out.withColumn("fingerprint", F.sha2(F.to_json(F.transform("fields", lambda f: F.struct(f["key"].alias("key"), f["kind"].alias("kind")))), 256))


def _values_meet(a: Column, b: Column) -> Column:
    """How well the values of two fields could be one quantity: 0 to 1, or -1 where they can't.

    Numbers: the gap between the ranges against their widths, and the widths against each other.
    Flags: .5, as two flags look alike. Texts: the share of common ones, -1 if both are few and
    none is common, .3 if they are many. A text and a number: .2 if each is the only value of its
    file, as a name and its code would be, else 0. No value: 0.
    """
    has = lambda f, bits: f["cls"].bitwiseAND(F.lit(bits)) > 0
    width = lambda f: f["hi"] - f["lo"]
    size = F.greatest(F.abs(a["lo"]), F.abs(a["hi"]), F.abs(b["lo"]), F.abs(b["hi"]))
    grain = size * 0.001 + 1e-9
    gap = F.greatest(F.greatest(a["lo"], b["lo"]) - F.least(a["hi"], b["hi"]), F.lit(0.0))
    alike = F.pow((F.least(width(a), width(b)) + grain) / (F.greatest(width(a), width(b)) + grain), 0.25)
    # two constants are near if they are equal; beyond that, within a twentieth of their size
    near = 1 / (1 + gap / (F.greatest(width(a) + width(b), size * 0.02) + 1e-9))
    common = F.least(*[F.bit_count(a[s].bitwiseAND(b[s])) for s in ("sig", "sig2")])  # two signatures, as a bit may be shared by chance
    either = F.bit_count(a["sig"].bitwiseOR(b["sig"]))
    few = either <= 24
    single = lambda f: F.when(f["cls"] == TEXT, F.bit_count(f["sig"]) == 1).otherwise((f["cls"].bitwiseAND(F.lit(TEXT)) == 0) & (f["lo"] == f["hi"]))
    texts = F.when(common > 0, F.greatest(common / either, F.lit(0.5))).when(few, -1.0)
    return (
        F.when((a["cls"] == 0) | (b["cls"] == 0), 0.0)
        .when(has(a, TEXT) & has(b, TEXT), F.when(few, texts).otherwise(0.3))
        .when(has(a, TEXT) | has(b, TEXT), F.when(single(a) & single(b), 0.2).otherwise(0.0))
        .when((a["cls"] == FLAG) & (b["cls"] == FLAG), 0.5)
        .when((a["cls"] == FLAG) | (b["cls"] == FLAG), 0.3 * near * alike)
        .otherwise(near * alike)
    )


def _names_meet(a: Column, b: Column) -> Column:
    """How alike two keys are, 0 to 1: by spelling without units, case and punctuation, by common words, or one within the other."""
    plain = lambda k: F.regexp_replace(F.regexp_replace(F.lower(k), r"[\[(][^\])]*[\])]", ""), "[^a-z0-9]", "")
    words = lambda k: F.filter(F.split(F.lower(F.regexp_replace(k, "([a-z0-9])([A-Z])", "$1_$2")), "[^a-z0-9]+"), lambda w: F.length(w) >= 3)
    p, q = plain(a), plain(b)
    shorter, longer = F.least(F.length(p), F.length(q)), F.greatest(F.length(p), F.length(q))
    spelling = 1 - F.levenshtein(p, q) / F.greatest(longer, F.lit(1))
    within = F.when((shorter >= 3) & (F.contains(p, q) | F.contains(q, p)), 0.7).otherwise(0.0)
    either = F.size(F.array_union(words(a), words(b)))
    common = F.when(either > 0, F.size(F.array_intersect(words(a), words(b))) / either).otherwise(0.0)
    return F.greatest(F.when(spelling >= 0.5, spelling).otherwise(0.5 * spelling), within, common)


@dataclass(frozen=True)
class Drift:
    """What the analysis of a corpus gives: the files' fingerprints, the steps between them, and the renames in each step."""

    prints: DataFrame
    steps: DataFrame
    renames: DataFrame  # file_id, pairs: array<struct<a, b>>


def analyse(files: DataFrame, records: DataFrame, aliases: Iterable[tuple[str, str]] = (), params: DriftParams = DriftParams()) -> Drift:
    """Fingerprints, steps and renames. `aliases` are optional pairs of names known to mean one thing; they count as proven."""
    p = params
    ensure_checkpoint_dir(records.sparkSession)
    prints = fingerprints(files, records).checkpoint()  # a row per file; everything below reads it, the records only once
    placed = prints.where(c("aircraft_id").isNotNull() & c("exported_at").isNotNull())
    month = F.floor(F.unix_seconds(c("exported_at").cast("timestamp")) / F.lit(30 * 86400.0)).cast("bigint")
    steps = previous_row(placed, "aircraft_id", ["exported_at", "file_id"], month, ["file_id", "fields", "fingerprint"])
    # an unchanged fingerprint needs no migration step
    steps = steps.where(c("prev_file_id").isNotNull() & (c("fingerprint") != c("prev_fingerprint")))
    keys = lambda f: F.transform(f, lambda x: x["key"])
    old, new = keys("prev_fields"), keys("fields")
    only = lambda fields, ks: F.filter(fields, lambda x: F.array_contains(ks, x["key"]))
    steps = steps.withColumns({"gone": only("prev_fields", F.array_except(old, new)), "come": only("fields", F.array_except(new, old))})
    steps = steps.select("file_id", "prev_file_id", "aircraft_id", "exported_at", "prev_fields", "fields", "gone", "come").checkpoint()

    pairs = steps.select("file_id", F.explode("gone").alias("g"), "come").select("file_id", "g", F.explode("come").alias("n"))
    pairs = pairs.select("file_id", c("g.key").alias("a"), c("n.key").alias("b"), _values_meet(c("g"), c("n")).alias("meet"))
    # what the whole corpus says of a pair of names
    per_key = prints.select("file_id", F.explode(keys("fields")).alias("key")).groupBy("key")
    per_key = per_key.agg(F.count(F.lit(1)).alias("n"), F.theta_sketch_agg("file_id", p.sketch_log_entries).alias("ids"))
    stats = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_steps"), F.avg("meet").alias("mean_meet"))
    for side in ("a", "b"):
        stats = stats.join(per_key.select(c("key").alias(side), c("n").alias(f"n_{side}"), c("ids").alias(f"ids_{side}")), side)
    stats = stats.crossJoin(F.broadcast(prints.agg(F.count(F.lit(1)).alias("n_files"))))  # one row
    both = F.theta_sketch_estimate(F.theta_intersection("ids_a", "ids_b"))
    expected = c("n_a") * c("n_b") / c("n_files")
    known = [F.lit(f"{x}\u0001{y}") for a, b in aliases for x, y in ((a, b), (b, a))]
    stats = stats.select(
        "a",
        "b",
        F.when(c("n_steps") >= p.pooled_steps, c("mean_meet")).alias("pooled"),
        (both > p.together * F.least("n_a", "n_b")).alias("apart_not"),
        (p.names * _names_meet(c("a"), c("b")) + F.when(both < 0.5, p.apart * F.least(expected, F.lit(3.0)) / 3.0).otherwise(0.0)).alias("base"),
        (F.concat("a", F.lit("\u0001"), "b").isin(*known) if known else F.lit(False)).alias("known"),
    )
    x = meet_salted(pairs, stats, ["a", "b"], c("file_id"), p.salts)
    meet = F.greatest("meet", F.coalesce("pooled", c("meet")))
    score = F.when(c("known"), 9.0).when(c("apart_not") | (meet < 0), 0.0).otherwise(p.values * meet + c("base"))
    x = x.withColumn("score", score).where(c("score") >= p.threshold)
    # the best pair first; a key takes part in one rename
    per_file = x.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct((-c("score")).alias("s"), "a", "b"))).alias("cand"))
    none = F.array().cast("array<struct<a:string,b:string>>")
    free = lambda acc, n: ~F.exists(acc, lambda t: (t["a"] == n["a"]) | (t["b"] == n["b"]))
    taken = F.aggregate("cand", none, lambda acc, n: F.when(free(acc, n), F.concat(acc, F.array(F.struct(n["a"].alias("a"), n["b"].alias("b"))))).otherwise(acc))
    return Drift(prints, steps, per_file.select("file_id", taken.alias("pairs")))


def _changes(d: Drift) -> DataFrame:
    x = d.steps.join(d.renames, "file_id", "left").withColumn("pairs", F.coalesce("pairs", F.array().cast("array<struct<a:string,b:string>>")))

    def change(kind: str, a: Column, b: Column) -> Column:
        return F.struct(F.lit(kind).alias("change_kind"), a.alias("old_name"), b.alias("new_name"))

    kinds = lambda f: F.map_from_entries(F.transform(F.filter(f, lambda y: y["kind"].isNotNull()), lambda y: F.struct(y["key"], y["kind"])))
    x = x.withColumns({"old": kinds("prev_fields"), "new": kinds("fields")})
    stayed = F.array_intersect(F.transform("prev_fields", lambda f: f["key"]), F.transform("fields", lambda f: f["key"]))
    same = F.transform(stayed, lambda k: F.struct(k.alias("a"), k.alias("b")))
    retyped = lambda t: F.coalesce(F.try_element_at("old", t["a"]) != F.try_element_at("new", t["b"]), F.lit(False))
    unpaired = lambda side, fields: F.filter(F.transform(fields, lambda f: f["key"]), lambda k: ~F.exists("pairs", lambda t: t[side] == k))
    rows = F.concat(
        F.transform(unpaired("b", "come"), lambda k: change("added", F.lit(""), k)),
        F.transform(unpaired("a", "gone"), lambda k: change("removed", k, F.lit(""))),
        F.transform("pairs", lambda t: change("renamed", t["a"], t["b"])),
        F.transform(F.filter(F.concat("pairs", same), retyped), lambda t: change("retyped", t["b"], t["b"])),
    )
    return x.select("file_id", "prev_file_id", "aircraft_id", "exported_at", F.inline(rows))


def schema_changes(files: DataFrame, records: DataFrame, aliases: Iterable[tuple[str, str]] = (), params: DriftParams = DriftParams()) -> DataFrame:
    """(file_id, change_kind, old_name, new_name): each file against its source's file exported just before.

    Files with a null aircraft or export time have no predecessor and are none; of files exported
    at one time the lower id is the earlier. Two keys whose scores tie pair in order of name.
    Empty tables give no rows; other columns are not read.
    """
    return _changes(analyse(files, records, aliases, params)).select("file_id", "change_kind", "old_name", "new_name")


def _rules(d: Drift, target: dict[str, str], aliases: Iterable[tuple[str, str]]) -> DataFrame:
    """(key, column): where the renames of the corpus lead each key. Keys that no chain of renames leads to a column of the target are left out.

    Names that are linked by renames form one component, whatever the order of the steps; its
    column is the one of the target that it holds (the first in order of name, should it hold two;
    a key that is a column itself stays).
    """
    links = _changes(d).where("change_kind = 'renamed'").select(c("old_name").alias("a"), c("new_name").alias("b")).distinct()
    known = list(aliases)
    if known:
        links = links.unionByName(links.sparkSession.createDataFrame(known, "a string, b string"))
    every = d.prints.select(F.explode(F.transform("fields", lambda f: f["key"])).alias("v")).distinct()
    labels = components(links, every)
    col = labels.where(c("v").isin(*target)).groupBy("component").agg(F.min("v").alias("column"))
    return labels.join(col, "component").select(c("v").alias("key"), F.when(c("v").isin(*target), c("v")).otherwise(c("column")).alias("column"))


def migration_steps(files: DataFrame, records: DataFrame, params: DriftParams = DriftParams()) -> DataFrame:
    """(aircraft_id, from_version, to_version, file_id, change_kind, old_name, new_name): the changes as steps between versions of the registry."""
    d = analyse(files, records, (), params)
    v = _versions(d.prints).select("aircraft_id", "fingerprint", "version")
    of_file = d.prints.select("file_id", "aircraft_id", "fingerprint")
    of_file = meet_salted(of_file.where("aircraft_id is not null"), v, ["aircraft_id", "fingerprint"], c("file_id"), params.salts).select("file_id", "version")
    x = _changes(d).join(of_file.withColumnRenamed("version", "to_version"), "file_id")
    x = x.join(of_file.select(c("file_id").alias("prev_file_id"), c("version").alias("from_version")), "prev_file_id")
    return x.select("aircraft_id", "from_version", "to_version", "file_id", "change_kind", "old_name", "new_name")


def _cast(rule: str, text: Column) -> Column:
    if rule == "flag":
        return F.when(F.lower(text).isin("true", "1", "1.0"), True).when(F.lower(text).isin("false", "0", "0.0"), False)
    if rule == "format":
        code = text.try_cast("double").cast("int")
        return F.when(code.between(1, len(FORMATS)), F.element_at(F.array(*[F.lit(f) for f in FORMATS]), code)).otherwise(text)
    return _number(text)


def consistent_records(
    files: DataFrame, records: DataFrame, target: dict[str, str] = TARGET, aliases: Iterable[tuple[str, str]] = (), params: DriftParams = DriftParams()
) -> DataFrame:
    """All records in one table: a column per entry of `target`, the file, its source and its schema version.

    Each file is routed through the rules of its own fingerprint, which the chained renames of the
    corpus give: rename the key to its column, default placeholders to null, cast to the column's
    type. What no rule knows is kept as text in `other`, a JSON object. A record without an object
    in its payload is kept with nulls. Of two keys of one column in a record, of two payloads under
    one number, and of a key that stands twice, the first non-null value in order of (key, text)
    counts. A file in no list has a null source and fingerprint and is routed by its own keys.
    """
    aliases = list(aliases)
    d = analyse(files, records, aliases, params)
    rules = _rules(d, target, aliases)
    # a rule set per distinct fingerprint, then one per file: rows of the size of a schema
    sets = d.prints.select("fingerprint", F.explode(F.transform("fields", lambda f: f["key"])).alias("key")).distinct()
    sets = meet_salted(sets, rules, ["key"], c("fingerprint"), params.salts).groupBy("fingerprint").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "column")))).alias("rules"))
    per_file = d.prints.select("file_id", "aircraft_id", "exported_at", "fingerprint")
    per_file = meet_salted(per_file, sets, ["fingerprint"], c("file_id"), params.salts, "left")
    v = _values(records).withColumn("text", F.when(~F.trim("text").isin(*PLACEHOLDERS), c("text")))
    # the values of a record come together first, then its file's rules meet it
    per_rec = v.groupBy("file_id", "rec_no").agg(F.array_sort(F.collect_set(F.when(c("text").isNotNull(), F.struct("key", "text")))).alias("cells"))
    every = records.select(c("file_id").cast("bigint").alias("file_id"), c("rec_no").cast("int").alias("rec_no")).distinct()
    x = every.join(per_rec, (every.file_id.eqNullSafe(per_rec.file_id)) & (every.rec_no.eqNullSafe(per_rec.rec_no)), "left").select(every.file_id, every.rec_no, "cells")
    x = meet_salted(x, per_file, ["file_id"], c("rec_no"), params.salts, "left")
    own = F.create_map(*[F.lit(n) for t in target for n in (t, t)])
    x = x.withColumn("rules", F.coalesce("rules", F.when(c("fingerprint").isNull(), own)))
    to = lambda key: F.try_element_at("rules", key)
    routed = F.transform("cells", lambda e: F.struct(to(e["key"]).alias("column"), e["key"].alias("key"), e["text"].alias("text")))
    x = x.withColumn("routed", routed)

    def value(column: str) -> Column:
        return F.try_element_at(F.filter("routed", lambda e: e["column"] == column), F.lit(1))["text"]

    rest = F.transform(F.filter("routed", lambda e: e["column"].isNull()), lambda e: F.struct(e["key"].alias("key"), e["text"].alias("text")))
    # of a key with several values the first one counts
    first = F.filter(rest, lambda e, i: (i == 0) | (F.get(rest, i - 1)["key"] != e["key"]))
    return x.select("file_id", "rec_no", *[_cast(rule, value(t)).alias(t) for t, rule in target.items()], F.to_json(F.map_from_entries(first)).alias("other"), "aircraft_id", "exported_at", "fingerprint")


def _versions(prints: DataFrame) -> DataFrame:
    seen = prints.groupBy("aircraft_id", "fingerprint").agg(F.min(F.struct("exported_at", "file_id")).alias("first"), F.count(F.lit(1)).alias("n_files"), F.max("fields").alias("fields"))
    # distinct schemas of a source, not its files
    version = F.row_number().over(W.partitionBy("aircraft_id").orderBy("first")).cast("bigint")
    return seen.withColumn("version", version)


def schema_registry(files: DataFrame, records: DataFrame) -> DataFrame:
    """Each distinct schema with its version per source (in order of first export), its fields and number of files."""
    v = _versions(fingerprints(files, records))
    return v.select("aircraft_id", "fingerprint", "version", c("first.file_id").alias("first_file_id"), "n_files", F.size("fields").cast("bigint").alias("n_fields"))
