"""Validation of decisions that arrive as untrusted JSON text: parse, coerce, clamp, default, never fail.

Fixed values: the bounds of each field and the allowed actions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FRAME_BOUNDS = {"keep_fraction": (0.3, 1.0, 0.75), "min_overall": (0.0, 0.5, 0.15)}
ACTIONS = ["accept", "retry", "flag_and_accept"]
FLOAT_BOUNDS = {"voxel_size": (0.3, 10.0), "min_consistency": (0.0, 0.9), "depth_min": (0.3, 500.0), "depth_max": (1.0, 1000.0), "prune_below": (0.0, 0.9), "densify_above": (0.1, 1.0)}
VERDICTS = ["accept", "needs_more_data", "reject"]
TRAINING_ACTIONS = ["continue", "stop_densifying", "early_stop"]
INT_BOUNDS = {"depth_window": (1, 5), "n_depths": (8, 96)}


#: An object alone, or between a line that opens a fence and one that closes it.
OBJECT = r"(?s)^\s*(?:`{3}[A-Za-z]*\s)?\s*(\{.*\})\s*(?:`{3}\s*)?$"


def parse(df: DataFrame, text: str) -> DataFrame:
    """Adds `obj`, the JSON object of the text, and `problem`, a code for why there is none.

    `no_text`, `no_object` (other JSON or prose), `broken_object` (braces that hold no JSON), or the
    message that the sender left under `__error__`.
    """
    body = F.regexp_extract(F.coalesce(F.col(text), F.lit("")), OBJECT, 1)
    x = df.withColumn("_any", F.when(body != "", F.try_parse_json(body)))
    failed = F.try_variant_get("_any", "$.__error__", "string")
    problem = F.when(F.coalesce(F.trim(F.col(text)), F.lit("")) == "", "no_text").when(body == "", "no_object").when(F.col("_any").isNull(), "broken_object").otherwise(failed)
    x = x.withColumn("problem", problem)
    return x.withColumn("obj", F.when(F.col("problem").isNull(), F.col("_any"))).drop("_any")


def text_of(key: str) -> Column:
    return F.try_variant_get("obj", f"$.{key}", "string")


def number_of(key: str) -> Column:
    return text_of(key).try_cast("double")


def clamp(v: Column, lo: float, hi: float) -> Column:
    """Null stays null, which the built-in least and greatest would not keep."""
    return F.when(v.isNotNull(), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), v)))


def _clamp_warning(key: str, v: Column, lo: float, hi: float) -> Column:
    return F.when(v < lo, F.concat(F.lit(f"raised:{key}:"), v.cast("string"))).when(v > hi, F.concat(F.lit(f"lowered:{key}:"), v.cast("string")))


def _type_warning(key: str) -> Column:
    return F.when(text_of(key).isNotNull() & number_of(key).isNull(), F.lit(f"no_number:{key}"))


def listed(key: str, items: int = 8, chars: int = 200) -> Column:
    """The texts and numbers of a list as texts, the first `items` entries looked at and `chars` characters of each kept; no list gives none."""
    entries = F.slice(F.try_variant_get("obj", f"$.{key}", "array<variant>"), 1, items)
    kind = lambda v: F.schema_of_variant(v)
    plain = F.filter(entries, lambda v: ~F.coalesce(kind(v).startswith("OBJECT") | kind(v).startswith("ARRAY") | kind(v).isin("VOID"), F.lit(True)))
    return F.coalesce(F.transform(plain, lambda v: F.substring(F.try_variant_get(v, "$", "string"), 1, chars)), F.array().cast("array<string>"))


def written(key: str, chars: int) -> Column:
    """A text cut to its field's length; what is no text is the empty one."""
    is_text = F.coalesce(F.schema_of_variant(F.try_variant_get("obj", f"$.{key}", "variant")) == "STRING", F.lit(False))
    return F.when(is_text, F.substring(text_of(key), 1, chars)).otherwise("")


def _choice(key: str, allowed: list[str], default: str) -> tuple[Column, Column]:
    """The chosen entry of a closed list, or the default, and the warning that goes with the latter."""
    got = text_of(key)
    known = F.coalesce(got.isin(allowed), F.lit(False))
    return F.when(known, got).otherwise(default), F.when(F.col("problem").isNull() & ~known, F.lit(f"other_{key}"))


def evaluation_report(df: DataFrame, text: str) -> DataFrame:
    """Adds valid, verdict, diagnosis, suggested_next_step and warnings. Numbers a report states are not taken over; an unusable text needs more data."""
    x = parse(df, text)
    verdict, other = _choice("verdict", VERDICTS, "needs_more_data")
    cols = {"valid": F.col("problem").isNull(), "verdict": verdict, "diagnosis": written("diagnosis", 2000), "suggested_next_step": written("suggested_next_step", 500)}
    return x.withColumns(cols | {"warnings": F.array_compact(F.array(F.col("problem"), other))}).drop("obj", "problem")


def training_control(df: DataFrame, text: str) -> DataFrame:
    """Adds valid, action, reasoning, agent_confidence and warnings; an unusable text lets the training go on, with confidence 0."""
    x = parse(df, text)
    action, other = _choice("action", TRAINING_ACTIONS, "continue")
    given = F.coalesce(number_of("agent_confidence"), F.lit(0.5))
    sure = F.when(F.col("problem").isNotNull(), 0.0).otherwise(clamp(given, 0.0, 1.0))
    warn = [F.col("problem"), other, _type_warning("agent_confidence"), F.when(F.col("problem").isNull(), _clamp_warning("agent_confidence", given, 0.0, 1.0))]
    cols = {"valid": F.col("problem").isNull(), "action": action, "reasoning": written("reasoning", 800), "agent_confidence": sure}
    return x.withColumns(cols | {"warnings": F.array_compact(F.array(*warn))}).drop("obj", "problem")


def frame_decision(df: DataFrame, text: str) -> DataFrame:
    """Adds valid, keep_fraction, min_overall, flags and warnings; an unusable text gives the defaults and one warning."""
    x = parse(df, text)
    cols, warn = {}, [F.col("problem")]
    for k, (lo, hi, default) in FRAME_BOUNDS.items():
        v = F.coalesce(number_of(k), F.lit(default))
        cols[k] = clamp(v, lo, hi)
        warn += [_type_warning(k), F.when(F.col("problem").isNull(), _clamp_warning(k, v, lo, hi))]
    cols |= {"flags": listed("flags"), "valid": F.col("problem").isNull(), "warnings": F.array_compact(F.array(*warn))}
    return x.withColumns(cols).drop("obj", "problem")


def reconstruction_decision(df: DataFrame, text: str) -> DataFrame:
    """Adds valid, action, the optional settings within bounds, agent_confidence and warnings.

    A pair that came out inverted (nearest depth beyond farthest, prune above densify) is dropped as
    a whole; an unusable text accepts with confidence 0.
    """
    x = parse(df, text)
    act = text_of("action")
    conf = number_of("agent_confidence")
    x = x.withColumns(
        {k: clamp(number_of(k), lo, hi) for k, (lo, hi) in FLOAT_BOUNDS.items()}
        | {k: clamp(F.bround(number_of(k)), lo, hi).cast("int") for k, (lo, hi) in INT_BOUNDS.items()}
        | {
            "valid": F.col("problem").isNull(),
            "action": F.when(act.isin(ACTIONS), act).otherwise("accept"),
            "agent_confidence": F.when(F.col("problem").isNotNull(), 0.0).otherwise(clamp(F.coalesce(conf, F.lit(0.5)), 0.0, 1.0)),
            "warnings": F.array_compact(
                F.array(
                    F.col("problem"),
                    F.when(F.col("problem").isNull() & ~F.coalesce(act.isin(ACTIONS), F.lit(False)), F.lit("other_action")),
                    *[_type_warning(k) for k in (*FLOAT_BOUNDS, *INT_BOUNDS, "agent_confidence")],
                    *[_clamp_warning(k, number_of(k), lo, hi) for k, (lo, hi) in (FLOAT_BOUNDS | INT_BOUNDS).items()],
                )
            ),
        }
    )
    for a, b in (("depth_min", "depth_max"), ("prune_below", "densify_above")):
        bad = F.coalesce(F.col(a) >= F.col(b), F.lit(False))
        x = x.withColumn("_bad", bad).withColumns({a: F.when(~F.col("_bad"), F.col(a)), b: F.when(~F.col("_bad"), F.col(b)), "warnings": F.when(F.col("_bad"), F.concat("warnings", F.array(F.lit(f"inverted:{a}:{b}")))).otherwise(F.col("warnings"))})
    return x.drop("obj", "problem", "_bad")
