"""Approval rules of growing ledgers, with the state of each thread kept by key.

A thread is what one ledger says under one correlation id.  Its state is one value: the recommendation it waits on and the
approval that stands.  Neither grows with history, and a micro-batch reads and writes the state of its own threads only.
What an action consumes is written out beside the violations; whether an action without a standing approval repeats a
consumed one, in whatever thread that was, is decided when the written rows are read.

Rows of a ledger have to come in the order of their positions, as its lines are appended; within a micro-batch they are put
in order per thread.  A row at or before its thread's last position was judged already and is passed over, so input that is
delivered again changes nothing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from crewgrid.operators.ledger import authorization_ok, effective_scope
from crewgrid.streaming.ledger_stream import _drain, _write, stored

STATE = "last long, pend_id string, pend_scope string, pend_auth string, pend_ok boolean, appr_id string, appr_scope string, appr_auth string"
FOUND = "rule string, ledger_id string, event_id string, position long, causation_id string"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COLUMNS = ("position", "event_id", "type", "requires_approval", "decision", "causation_id", "scope", "eff_scope", "auth", "auth_ok", "entitled", "logged_entitled")


def judge(state, e):
    """(new state, rules of the event).  state: pend_* and appr_* by name; e: one event's columns by name."""
    if e["type"] == "recommendation":
        if e["requires_approval"]:
            state = state | {"pend_id": e["event_id"], "pend_scope": e["scope"], "pend_auth": e["auth"], "pend_ok": e["auth_ok"]}
        return state, []
    if e["type"] == "approval":
        waits = state["pend_id"] is not None and e["causation_id"] == state["pend_id"]
        scope = waits and state["pend_scope"] == e["eff_scope"]
        bound = scope and state["pend_ok"] and e["auth_ok"] and state["pend_auth"] == e["auth"]
        rules = [] if bound else ["approval_unbound" if not waits else "approval_scope_pivot" if not scope else "approval_substituted"]
        rules += ["approval_flag_disagrees"] * (e["logged_entitled"] != e["entitled"]) + ["approval_forged"] * (e["decision"] == "approved" and not e["entitled"])
        if e["decision"] == "denied":
            state = state | {"appr_id": None}
        elif e["decision"] == "approved" and e["entitled"] and bound:
            state = state | {"appr_id": e["event_id"], "appr_scope": e["eff_scope"], "appr_auth": e["auth"]}
        return state, rules
    if state["appr_id"] is None:
        return state, ["action_ungated"]
    rules = ["action_cause"] * (e["causation_id"] != state["appr_id"]) + ["action_scope"] * (e["scope"] != state["appr_scope"])
    rules += ["action_substituted"] * (not e["auth_ok"] or e["auth"] != state["appr_auth"])
    return (state, rules) if rules else (state | {"appr_id": None}, ["consumed"])


class Threads(StatefulProcessor):
    def init(self, handle):
        self.held = handle.getValueState("thread", STATE)
        self.names = [x.split(" ")[0] for x in STATE.split(", ")]

    def handleInputRows(self, key, rows, timer_values):
        was = self.held.get() if self.held.exists() else (-1,) + (None,) * (len(self.names) - 1)
        state, out = dict(zip(self.names, was)), []
        batch = pd.concat(list(rows)).sort_values("position", kind="stable")
        events = [batch[c].astype(object).where(batch[c].notna(), None).tolist() for c in COLUMNS]
        for values in zip(*events):
            e = dict(zip(COLUMNS, values))
            if e["position"] <= state["last"]:
                continue
            state, rules = judge(state, e)
            state["last"] = int(e["position"])
            out += [(r, key[0], e["event_id"], e["position"], e["causation_id"]) for r in rules]
        self.held.update(tuple(state[n] for n in self.names))
        yield pd.DataFrame(out, columns=["rule", "ledger_id", "event_id", "position", "causation_id"])

    def close(self):
        pass


def _threads(events):
    text = lambda c: F.col(c).cast("string").alias(c)
    good = F.col("auth_ok") if "auth_ok" in events.columns else authorization_ok()
    e = events.where(F.col("type").isin("recommendation", "approval", "action")).select(
        text("ledger_id"), F.coalesce(F.col("correlation_id").cast("string"), F.lit("")).alias("thread"), F.col("position").cast("long").alias("position"), text("event_id"), "type",
        F.coalesce("requires_approval", F.lit(False)).alias("requires_approval"), "decision", text("causation_id"), "scope", effective_scope().alias("eff_scope"), "auth", good.alias("auth_ok"),
        F.coalesce("entitled", F.lit(False)).alias("entitled"), F.coalesce("logged_entitled", F.lit(False)).alias("logged_entitled"))
    return e.groupBy("ledger_id", "thread").transformWithStateInPandas(Threads(), FOUND, "Append", "None")


def add(stream, folder, checkpoint):
    """Judges what the stream has got since the last call, and stores violations and consumed approvals."""
    spark = stream.sparkSession
    was = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)  # keyed value state needs it
    try:
        _drain(_threads(stream), lambda df, number: _write(df, folder, number), checkpoint)
    finally:
        spark.conf.set(PROVIDER, was)


def violations(spark, folder):
    """(rule, ledger_id, key) of all rows so far; an action on an approval that was consumed before is a replay."""
    rows = stored(spark, folder, FOUND).drop("batch")
    used = rows.where("rule = 'consumed'").groupBy("ledger_id", "causation_id").agg(F.min("position").alias("used_at"))
    j = rows.where("rule <> 'consumed'").join(used, ["ledger_id", "causation_id"], "left")
    replay = (F.col("rule") == "action_ungated") & F.coalesce(F.col("used_at") < F.col("position"), F.lit(False))
    return j.select(F.when(replay, "action_replay").otherwise(F.col("rule")).alias("rule"), "ledger_id", F.col("event_id").alias("key"))
