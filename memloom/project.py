"""A project's memory: one shared store, one per agent, and an inbox of handoffs between agents."""

from __future__ import annotations

import re
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.engine import Memory
from memloom.operators import query

EPISODE = "place int, content string, context string, agent_id string, salience_hint double, doc_id string, chunk_id string, verified boolean, confidence double"


class Project:
    """Stores under one root: ``shared`` for all agents, ``agents/NAME`` for each, ``handoffs`` as JSON lines."""

    def __init__(self, spark: SparkSession, root: str, agent: str):
        if not re.fullmatch(r"[\w.-]{1,64}", agent):
            raise ValueError("an agent's name has at most 64 letters, digits, dots and dashes")
        self.spark, self.root, self.agent = spark, root.rstrip("/"), agent
        self.shared = Memory(spark, f"{self.root}/shared", "shared")
        self.own = Memory(spark, f"{self.root}/agents/{agent}", agent)

    def remember(self, content: str, context: str = "note", salience: float = 0.55, shared: bool = True, **ref) -> DataFrame:
        """Store one text; returns its verdict."""
        row = (0, content, context, self.agent, salience, ref.get("doc_id"), ref.get("chunk_id"), ref.get("verified"), ref.get("confidence"))
        return (self.shared if shared else self.own).experience(self.spark.createDataFrame([row], EPISODE))

    def recall(self, cue: str, scope: str = "all", limit: int = 12) -> list[tuple[str, str, float]]:
        """(side, engram_id, activation) of the best rows of both stores, or of one (``project``, ``agent``)."""
        out = [("project", *r) for r in self.shared.activate(cue, limit)] if scope in ("all", "project") else []
        out += [("agent", *r) for r in self.own.activate(cue, limit, self.agent)] if scope in ("all", "agent") else []
        return sorted(out, key=lambda r: (-round(r[2], 9), r[0], r[1]))[:limit]

    def handoffs(self) -> DataFrame:
        """All handoffs of the inbox; broken lines are left out."""
        h = self.spark.read.schema(query.HANDOFF_JSON + ", _broken string").option("columnNameOfCorruptRecord", "_broken")
        try:
            return h.json(f"{self.root}/handoffs").filter("_broken is null").drop("_broken")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], query.HANDOFF_JSON)

    def handoff(self, summary: str, subdir: str = "", status: str = "paused", next_steps: list[str] | None = None, files: list[str] | None = None, session: str = "") -> str:
        """Append a handoff to the inbox and store it as a row of the shared memory; returns its id."""
        if status not in ("paused", "done", "blocked"):
            raise ValueError("status is paused, done or blocked")
        hid = uuid.uuid4().hex[:8]
        row = (self.agent, subdir, session, status, summary, next_steps or [], files or [], hid, datetime.now(timezone.utc).isoformat(timespec="seconds"))
        h = self.spark.createDataFrame([row], query.HANDOFF_JSON)
        h.coalesce(1).write.mode("append").json(f"{self.root}/handoffs")
        text = h.select(query.handoff_content(h).alias("c"), query.context_key(F.col("agent"), query.normal_subdir(F.col("subdir"))).alias("k")).first()
        self.remember(text["c"], text["k"], 0.8).count()
        return hid

    def session_context(self, subdir: str | None = None, facts: int = 5, last: int = 3) -> str:
        """What an agent should know at the start: verified facts and the newest handoffs, as text."""
        rows = self.shared.rows()
        block = query.prompt_block(query.verified_context(rows, facts)).first()
        lines = [block["block"]] if block else []
        h = query.list_handoffs(self.handoffs(), subdir=subdir, limit=last).join(self.handoffs().select("handoff_id", "summary"), "handoff_id").orderBy(F.desc_nulls_last("created"), "handoff_id").collect()
        if h:
            lines.append("## Handoffs\n" + "\n".join(f"- [{r['status']}] {r['agent']} in {r['subdir'] or 'root'}: {r['summary']}" for r in h))
        return "\n\n".join(lines)
