"""Command line over a store: ``python -m memloom ROOT VERB [ARGUMENT ...]``."""

from __future__ import annotations

import json
import sys

from memloom.engine import Memory
from memloom.session import local_session

VERBS = {"remember": "TEXT [CONTEXT]", "recall": "CUE", "forget": "ID", "verify": "ID", "core": "ID [KEY]", "tick": "[N]", "sleep": "", "compact": "", "death": "[CAUSE]", "status": "", "stage": "", "checkpoint": "", "check": ""}


def run(m: Memory, verb: str, args: list[str]):
    """The verb's result as something JSON can say."""
    if verb == "remember":
        rows = m.spark.createDataFrame([(0, args[0], args[1] if len(args) > 1 else "note")], "place int, content string, context string")
        return [r.asDict() for r in m.experience(rows).collect()]
    if verb == "recall":
        return [{"engram_id": i, "activation": a} for i, a in m.activate(args[0])]
    if verb == "status":
        return [r.asDict() for r in m.status().collect()]
    if verb == "stage":
        return m.control()
    if verb == "check":
        return [r.asDict() for r in m.store.verify().collect()]
    if verb == "sleep":
        return {"replayed": m.sleep()["replayed"].count()}
    if verb == "tick":
        return {"slept": m.tick(int(args[0]) if args else 1)}
    return {"forget": m.forget, "verify": m.verify, "core": m.mark_core, "compact": m.compact, "death": m.death, "checkpoint": m.checkpoint}[verb](*args)


def main(argv: list[str]) -> int:
    if len(argv) < 2 or argv[1] not in VERBS:
        print("\n".join(["usage: python -m memloom ROOT VERB [ARGUMENT ...]", *(f"  {v} {a}" for v, a in VERBS.items())]))
        return 2
    print(json.dumps(run(Memory(local_session(), argv[0]), argv[1], argv[2:]), default=str, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
