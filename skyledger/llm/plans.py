"""Queries of problems 4, 6, 7 and 8, with SQL where SQL can say it."""

from __future__ import annotations

from skyledger.llm.mixing import mixed_documents, mixture, reached_shares, sized_documents
from skyledger.llm.nearest import matched_frames
from skyledger.llm.tokens import token_ids
from skyledger.llm.truncation import cut_documents, cut_rates
from skyledger.tables import table


def _matched(s, d):
    return matched_frames(*[table(s, d, t) for t in ("frames", "telemetry", "fused_pose", "log_formats")])


QUERIES = {
    "p4_found": _matched,
    "p6_ids": lambda s, d: token_ids(table(s, d, "documents")),
    "p7_mix": lambda s, d: mixture(sized_documents(table(s, d, "documents")), table(s, d, "mix_targets")),
    "p7_shares": lambda s, d: reached_shares(sized_documents(table(s, d, "documents")), table(s, d, "mix_targets")),
    "p7_shares_exact": lambda s, d: reached_shares(sized_documents(table(s, d, "documents")), table(s, d, "mix_targets"), short="shrink"),
    "p7_texts": lambda s, d: mixed_documents(table(s, d, "documents"), sized_documents(table(s, d, "documents")), table(s, d, "mix_targets")),
    "p8_found": lambda s, d: cut_documents(table(s, d, "documents")),
    "p8_rates": lambda s, d: cut_rates(table(s, d, "documents")),
}

SQL = {
    "p4_found": """
WITH tol AS (SELECT flight_id, min(match_tol_s) AS tol FROM (SELECT DISTINCT flight_id, format_detected FROM telemetry) JOIN log_formats USING (format_detected) GROUP BY 1),
f AS (SELECT DISTINCT flight_id, idx, t, tol FROM frames JOIN tol USING (flight_id)),
r AS (SELECT DISTINCT 'telemetry' AS side, flight_id, seq AS no, t_sec AS t FROM telemetry WHERE t_sec IS NOT NULL
      UNION ALL SELECT DISTINCT 'fused_pose', flight_id, pose_no, t FROM fused_pose WHERE t IS NOT NULL),
c AS (SELECT f.flight_id, f.idx, r.side, r.no, abs(f.t - r.t) AS d,
        row_number() OVER (PARTITION BY f.flight_id, f.idx, r.side ORDER BY abs(f.t - r.t), r.no) AS rn
      FROM f JOIN r ON f.flight_id = r.flight_id AND r.t BETWEEN f.t - f.tol - 0.001 AND f.t + f.tol + 0.001 WHERE abs(f.t - r.t) <= f.tol)
SELECT flight_id, idx, side AS matched_table, no AS matched_no FROM c WHERE rn = 1
""",
}
