"""The ordered gate moves texts once and pairs no rows; peers and Jaccards against a plain walk."""

import random

from test_core import rows

from memloom.functions import stages as S
from memloom.operators import gate


def test_ordered_gate_pairs_no_rows(spark):
    # pairs of rows with a word in common filled the disk
    r = rows(spark, [{"content": f"alpha beta {i}"} for i in range(5)])
    plan = gate.ordered_gate(r)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_ordered_gate_peers_against_a_plain_walk(spark):
    rng = random.Random(8)
    base = [[f"w{rng.randrange(60)}" for _ in range(rng.randint(1, 25))] for _ in range(12)]
    items = []
    for k in range(500):
        ws = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2, 5])):
            ws[rng.randrange(len(ws))] = f"w{rng.randrange(60)}"
        items.append({"content": rng.choice([" ".join(ws), " ".join(ws), " ".join(ws), "", None]) if k % 9 == 0 else " ".join(ws), "tenant_id": rng.choice(["a", "b", None]), "separation_index": rng.choice([0.0, 0.4]), "context": rng.choice(["x", "x", "ledger:1"])})
    r = rows(spark, items)
    want, scopes = {}, {}
    ordered = sorted(r.collect(), key=lambda x: (x["encoded_at_tick"] is not None, x["encoded_at_tick"] or 0, x["engram_id"]))
    for x in ordered:
        kept, ws = scopes.setdefault(x["tenant_id"] or "", []), set((x["content"] or "").lower().split())
        best = None
        for oid, osep, other in kept[-15:]:
            j = round(len(ws & other) / len(ws | other), 9) if ws and other else 0.0
            if j >= S.REVIEW and (best is None or j > best[0]):
                best = (j, oid, osep)
        ok = x["context"].startswith("ledger:") or best is None or not (best[0] >= S.REJECT or max(best[2], 1 - best[0]) < S.MIN_SEPARATION)
        if ok:
            kept.append((x["engram_id"], x["separation_index"] or 0.0, ws))
        want[x["engram_id"]] = (best and best[1], best and best[0], ok)
    got = {x["engram_id"]: (x["peer"], x["jaccard"], x["accepted"]) for x in gate.ordered_gate(r, window=15).collect()}
    assert got == want and 20 < sum(not v[2] for v in want.values()) < 480
