"""Stage table, weights and limits of the memory model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Stage, name, spread factor, prune threshold, most edges, needed rows, sleeps, ticks, pruned edges, clique, granule chain, bound chain, band chain, granule-to-band edges (fixed values).
STAGES = (
    (0, "embryonic", 0.1, 0.001, 1_000, 0, 0, 0, 0, 2, 4, 4, 4, 8),
    (1, "newborn", 0.2, 0.005, 50_000, 0, 0, 1, 0, 3, 6, 6, 6, 12),
    (2, "infant", 0.35, 0.01, 200_000, 3, 0, 3, 0, 3, 8, 8, 8, 16),
    (3, "child", 0.5, 0.02, 500_000, 15, 1, 20, 0, 3, 8, 8, 8, 16),
    (4, "adolescent", 0.7, 0.03, 1_000_000, 50, 3, 100, 10, 4, 10, 10, 12, 24),
    (5, "adult", 0.85, 0.04, 2_000_000, 150, 8, 300, 100, 4, 10, 10, 12, 24),
    (6, "expert", 1.0, 0.05, 5_000_000, 500, 20, 1_000, 500, 4, 10, 10, 12, 24),
)
STAGE_SCHEMA = "stage int, name string, spread double, prune double, max_edges long, need_rows long, need_sleeps long, need_ticks long, need_pruned long, clique int, row_chain int, feature_chain int, band_chain int, cross int"

#: Seeds, hops and floors of recall; score weights; gate, separation and merge limits; replay and decay (fixed values).
LEXICAL_SEEDS, VECTOR_SEEDS, CANDIDATES, HOPS, TOP_K = 64, 50, 128, 4, 8
SPREAD, MIN_DELTA, ACTIVATION_FLOOR, SCORE_FLOOR = 0.6, 0.001, 0.01, 0.05
W_OVERLAP, W_ACTIVATION, W_COSINE, VERIFIED_BOOST = 0.45, 0.35, 0.20, 0.15
SIM_FLOOR, BOOST_RATE = 0.05, 0.1
REJECT, REVIEW, MIN_SEPARATION, GATE_WINDOW = 0.85, 0.72, 0.35, 512
OVERLAP_LIMIT, SEPARATORS, SEPARATION_RING = 0.28, 6, 12
CLIQUE_WEIGHT, CHAIN_WEIGHT, BOUND_WEIGHT, BAND_WEIGHT, CROSS_WEIGHT, BRIDGE_WEIGHT, HEBB_DELTA = 0.3, 0.2, 0.3, 0.25, 0.18, 0.25, 0.05
MERGE_JACCARD, MERGE_COSINE, MERGE_BOTH = 0.85, 0.94, 0.35
REPLAY_ROWS, FACT_RATE, DECAY = 16, 0.1, 0.01
CENTROID_FLOOR = 0.72
SLEEP_INTERVAL, SLEEPS_PER_WINDOW, SLEEP_WINDOW = 360, 6, 3600
MODULATORS = {"dopamine": 0.5, "acetylcholine": 0.7, "norepinephrine": 0.3, "serotonin": 0.5}
PAGE, MAX_PAGE = 50, 200
QUOTA_ROWS, MAX_CONTENT = 50_000, 8192
FOVEA_WIDTH, FOVEA_STEP, FOVEA_SIDE = 12, 8, 80


def stage_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(STAGES), STAGE_SCHEMA)


#: Ledger preference: cue words, row words; kinds of provenance with their display names (fixed values).
LEDGER_CUES = ("balance", "wallet", "ledger", "$", "money", "credit")
LEDGER_ROWS = ("wallet", "balance", "ledger")
KIND_NAMES = {"chat_assertion": "ChatAssertion", "file_observation": "FileObservation", "tool_grounded": "ToolGrounded", "ledger_verified": "LedgerVerified", "user_explicit": "UserExplicit"}
COMPACT_EVERY, COMPACT_PRESSURE, SLEEP_PRESSURE = 48, 0.7, 0.92
