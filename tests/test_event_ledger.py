"""Canonical JSON against the json module, and ledgers of JSON lines: clean ones stay clean, each tampering is named."""

import hashlib
import hmac
import json
import random

import pytest

from crewgrid.functions import canonical as cj
from crewgrid.operators import event_ledger as el

KEY = b"k" * 70
HEX = "sha256:" + "ab" * 32
AUTH = {"bundle_id": "pack-1", "bundle_hash": HEX, "material_claim_ids_hash": HEX, "artifacts": [{"artifact_id": "a", "content_hash": HEX, "evidence_hash": HEX}, {"artifact_id": "b", "content_hash": HEX, "evidence_hash": HEX}]}


def canon(v):
    return json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_canonical_json_equals_the_json_module(spark):
    rnd = random.Random(3)

    def value(depth=0):
        k = rnd.randrange(9 if depth < 4 else 6)
        if k == 0:
            return rnd.choice([0, 5, -17, 10**20, 123456789012345678])
        if k == 1:
            return rnd.choice([0.0, -0.0, 1.0, 1.5, -2.25, 1e16, 1e15, 123456.789, 1e-4, 1e-5, 3.3e-7, 1e22, 5e-324, 0.1 + 0.2, 100.0, 1e100])
        if k == 2:
            return rnd.choice(["", "snake", "n5", "é", 'q"uote', "back\\slash", '\\"', "\x1f\x0b\b\n\t", "/", '{"a": 1}', "\U0001f600"])
        if k == 3:
            return rnd.choice([True, False, None])
        if k in (4, 5):
            return "plain, text: x"
        return {rnd.choice(["b", "a", "aa", "Z", "é", "n", "s", 'k"ey']): value(depth + 1) for _ in range(rnd.randrange(4))} if k < 8 else [value(depth + 1) for _ in range(rnd.randrange(4))]

    rows = []
    for i in range(300):
        v = value()
        rows.append((json.dumps(v, ensure_ascii=bool(i % 2), indent=rnd.choice([None, 1]), separators=rnd.choice([None, (" , ", " : ")])), canon(v), json.dumps(v, sort_keys=True)))
    bad = ['{"a":1,"a":2}', "{", "01", "[1,]", "NaN", '{"a":1e999}', "1.", '{"x":Infinity}', "", None]
    told = ['{"a":1.50}', "-0", "-0.0", "[1.0e0,2.50e-3,1E5,0.1e1]", '"\\/\\u00e9"']
    rows += [(t, None, None) for t in bad] + [(t, canon(json.loads(t)), json.dumps(json.loads(t), sort_keys=True)) for t in told]
    df = spark.createDataFrame(rows, "t string, want string, spaced string")
    for r in df.select("*", cj.canonical("t").alias("got"), cj.dumped(cj.canonical("t")).alias("dump")).collect():
        assert (r.got, r.dump) == (r.want, r.spaced), r.t


def event(kind="fyi", actor="ann", **more):
    return {"ts": "2000-01-01", "actor": {"id": actor, "display": actor.title(), "kind": "human", "role": "staff"}, "channel": "c", "type": kind, "payload": {"é": 1.5}, **more}


def thread(case="T1", by="ann", decision="approved", **approval):
    """Recommendation, approval and action; causes are filled in by `ledger`."""
    held = dict(correlation_id=case, scope="publish", authorization=AUTH)
    said = {"decision": decision, "entitled": True, "by": by, "scope": "publish", "registry_version": "v1", **approval}
    return [event("recommendation", requires_approval=True, **held), event("approval", by, approval=said, **held), event("action", gated=True, **held)]


def ledger(events, secret=None):
    out, prev, last = [], "0" * 64, None
    for i, e in enumerate(events):
        e = {k: v for k, v in e.items() if k != "_cause"} | {"schema_version": "1.2", "sequence": i, "prev_hash": prev}
        if e["type"] in ("approval", "action") and "causation_id" not in e:
            e["causation_id"] = last
        e["event_id"] = sha(canon(e))[:32]
        prev = e["event_hash"] = sha(canon(e))
        last = e["event_id"]
        if secret:
            e["hmac"] = hmac.new(secret, prev.encode(), hashlib.sha256).hexdigest()
        out.append(e)
    return out


def resealed(e):
    """An event whose id and hash were made to fit its changed content."""
    e = {k: v for k, v in e.items() if k not in ("event_id", "event_hash", "hmac")}
    e["event_id"] = sha(canon(e))[:32]
    e["event_hash"] = sha(canon(e))
    return e


@pytest.fixture(scope="module")
def registry(spark):
    return (
        spark.createDataFrame([("ann", "human", "staff", "Ann"), ("bob", "human", "staff", "Bob")], "actor_id string, kind string, role string, display string"),
        spark.createDataFrame([("publisher", "ann")], "role string, actor_id string"), spark.createDataFrame([("publish", "publisher")], "scope string, role string"))


def found(spark, cases, secret=None, registry=None):
    rows = [(name, i, line if isinstance(line, str) else canon(line)) for name, lines in cases.items() for i, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "ledger_id string, line_no long, line string").repartition(3)
    members = None if registry is None else spark.createDataFrame([("ann", "c"), ("bob", "c")], "actor_id string, channel string")
    got = {}
    for r in el.verify(df, secret, registry, members, registry and "v1").collect():
        got.setdefault(r.ledger_id, set()).add((r.rule, int(r.key)))
    return got


def test_clean_ledgers_and_tamperings(spark, registry):
    plain = [event(payload={"i": i}) for i in range(4)]
    good = ledger(plain)
    edit = lambda i, **new: [dict(e, **new) if k == i else e for k, e in enumerate(good)]
    cases = {
        "clean": ledger(plain + thread() + thread("T2")), "blank lines": [*good[:2], "  ", *good[2:]],
        "edited": edit(1, payload={"i": 9}), "edited and resealed": [good[0], resealed(dict(good[1], payload={"i": 9})), *good[2:]],
        "dropped": [good[0], *good[2:]], "swapped": [good[1], good[0], *good[2:]], "repeated": [*good, good[3]],
        "spaced": [json.dumps(good[0], sort_keys=True), *good[1:]], "doubled key": ['{"type":"fyi",' + canon(good[0])[1:], *good[1:]], "cut": [good[0], canon(good[1])[:-1], "also bad"], "list": ["[1]", *good],
        "personal": ledger([event(payload={"to": "someone@mail.test.de"})]), "no actor": ledger([{k: v for k, v in event().items() if k != "actor"}]),
        "odd shapes": ledger([event(payload=[1], scope=" ", requires_approval="yes", gated=1, approval=[], causation_id="x"), event("note", channel="")]),
        "no envelope": ledger([event("recommendation", requires_approval=True, correlation_id="T", scope="publish")]),
        "bad envelope": ledger([event("recommendation", requires_approval=True, correlation_id="T", scope="publish", authorization=dict(AUTH, artifacts=AUTH["artifacts"][::-1]))]),
        "keys": ledger([event(idempotency_key="k"), event(idempotency_key="k", payload={})]),
    }
    got = found(spark, cases, None, registry)
    assert "clean" not in got and "blank lines" not in got
    assert got["edited"] == {("event_id_content", 1), ("tampered", 1)} and got["edited and resealed"] == {("broken_chain", 2)}
    assert got["dropped"] == {("sequence_disorder", 1), ("sequence_disorder", 2), ("broken_chain", 1)}
    assert got["swapped"] == {("sequence_disorder", 0), ("sequence_disorder", 1), ("broken_chain", 0), ("broken_chain", 1), ("broken_chain", 2)}
    assert got["repeated"] == {("sequence_disorder", 4), ("broken_chain", 4), ("duplicate_event_id", 4)}
    assert got["spaced"] == {("non_canonical", 0)} and got["doubled key"] == {("invalid_json", 0)} and got["cut"] == {("invalid_json", 1)} and got["list"] == {("not_an_object", 0)}
    assert got["personal"] == {("personal_data", 0)} and got["no actor"] == {("missing_actor", 0), ("actor_keys", 0)}
    assert got["odd shapes"] == {(r, 0) for r in ("payload_object", "scope_text", "requires_approval_boolean", "gated_boolean", "approval_object", "cause_not_earlier")} | {("unknown_type", 1), ("channel_empty", 1)}
    assert got["no envelope"] == {("authorization_missing", 0)} and got["bad envelope"] == {("authorization_order", 0)} and got["keys"] == {("double_processed", 1)}


def test_signatures(spark):
    signed = ledger([event(payload={"i": i}) for i in range(3)], KEY)
    cases = {"good": signed, "forged": [signed[0], dict(signed[1], hmac="0" * 64), signed[2]], "unsigned": ledger([event()])}
    assert found(spark, cases, KEY) == {"forged": {("bad_signature", 1)}, "unsigned": {("bad_signature", 0)}}
    assert found(spark, {"good": signed}) == {"good": {("signed_without_key", i) for i in range(3)}}


def test_approvals(spark, registry):
    def changed(i, **new):
        t = thread()
        t[i] = dict(t[i], **new)
        return ledger(t)

    replay = ledger(thread())
    again = {k: v for k, v in replay[2].items() if k not in ("event_id", "event_hash")}
    again |= {"sequence": 3, "prev_hash": replay[2]["event_hash"], "payload": {"again": 1}}
    cases = {
        "laundered": ledger([thread()[0], thread()[2]]), "not entitled": ledger(thread(by="bob")), "replayed": [*replay, resealed(again)],
        "pivot": changed(1, scope="other", approval={**thread()[1]["approval"], "scope": "other"}), "substituted": changed(2, authorization=dict(AUTH, bundle_hash=HEX[:-1] + "0")),
        "by other": ledger(thread(registry_version="v0", scope="other") [:2]), "denied": ledger([*thread(decision="denied")]), "no version": ledger(thread(registry_version="")),
    }
    cases["by other"] = ledger([thread()[0], dict(thread()[1], approval={**thread()[1]["approval"], "by": "bob", "scope": "other", "registry_version": "v0"})])
    got = found(spark, cases, None, registry)
    assert got["laundered"] == {("action_ungated", 1)} and got["replayed"] == {("action_replay", 3)}
    assert got["not entitled"] == {("approval_flag_disagrees", 1), ("approval_forged", 1), ("action_ungated", 2)}
    assert {("approval_scope_pivot", 1), ("action_ungated", 2)} <= got["pivot"] and got["substituted"] == {("action_substituted", 2)}
    assert got["by other"] == {("approval_by_other", 1), ("approval_scope_differs", 1), ("registry_version_differs", 1)}
    assert got["denied"] == {("action_ungated", 2)} and got["no version"] == {("registry_version_missing", 1)}


def test_registry_version(spark):
    reg = {"actors": {"ann": {"display": "Änn \U0001f600", "kind": "human"}}, "roles": {"r": ["ann"]}, "scopes": {"s": "r"}, "channels": {}, "note": "not covered"}
    want = hashlib.sha256(json.dumps({k: reg[k] for k in ("actors", "roles", "scopes", "channels")}, sort_keys=True).encode()).hexdigest()[:12]
    assert spark.createDataFrame([(json.dumps(reg),)], "t string").select(el.registry_version("t")).first()[0] == want


def test_stream_state_equals_batch_over_restarts(spark, registry, tmp_path):
    """Threads cut by restarts, a thread without id, a replay from another thread, and a part that is delivered twice."""
    from pyspark.sql import functions as F

    from crewgrid.operators.ledger import approval_rules
    from crewgrid.streaming import approval_state as st

    def rows(case, at, kind, cause=None, decision=None, scope="s", auth="sha256:1", entitled=True, requires=True):
        return (7, case, at, f"e{at}", kind, kind == "recommendation" and requires, decision, cause, scope, None, auth, entitled, entitled)

    held = [
        rows("A", 1, "recommendation"), rows("A", 2, "approval", "e1", "approved"), rows("B", 3, "recommendation"), rows("B", 4, "approval", "e3", "approved", scope="t"),
        rows("A", 5, "action", "e2", auth="sha256:2"), rows("A", 6, "action", "e2"), rows("A", 7, "action", "e2"), rows("C", 8, "action", "e2"), rows("B", 9, "approval", "e3", "approved"),
        rows("B", 10, "approval", "e3", "denied"), rows("B", 11, "action", "e9"), rows(None, 12, "recommendation"), rows(None, 13, "approval", "e12", "approved", entitled=False),
        rows(None, 14, "approval", "e12", "approved"), rows(None, 15, "action", "e14"), rows("A", 16, "action", "e2"), rows("D", 17, "recommendation", requires=False), rows("D", 18, "approval", "e17", "approved"),
    ]
    schema = "ledger_id long, correlation_id string, position long, event_id string, type string, requires_approval boolean, decision string, causation_id string, scope string, approval_scope string, auth string, entitled boolean, logged_entitled boolean"
    df = spark.createDataFrame(held, schema)
    for part, where in enumerate(("position <= 4", "position between 5 and 9", "position between 5 and 9", "position > 9")):
        df.where(where).orderBy(F.desc("position")).write.parquet(f"{tmp_path}/in/part={part}")
        st.add(spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state")
    got = sorted((r.rule, r.ledger_id, r.key) for r in st.violations(spark, f"{tmp_path}/out").collect())
    want = sorted((r.rule, str(r.ledger_id), r.key) for r in approval_rules(df).collect())
    assert got == want and {"action_replay", "action_ungated", "action_substituted", "approval_scope_pivot", "approval_forged", "approval_unbound"} <= {r for r, _, _ in got}


def test_lines_are_parsed_for_one_stored_table(spark, monkeypatch):
    """Unreadable ledgers are found among the stored events, not by parsing all lines a second time."""
    plans, keep = [], el.stored
    monkeypatch.setattr(el, "stored", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df))
    df = spark.createDataFrame([("a", 1, "{}"), ("b", 1, "{"), ("b", 2, "[]")], "ledger_id string, line_no long, line string")
    bad, events = el.read(df)
    assert [(r.rule, r.ledger_id, r.key) for r in bad.collect()] == [("invalid_json", "b", "0")] and [r.ledger_id for r in events.collect()] == ["a"]
    assert sum("parseJson" in p for p in plans) == 1


def test_rules_read_only_their_columns(spark, registry, monkeypatch):
    """What a group of rules does not read is neither computed nor stored, and its violations stay the same."""
    from pyspark.sql import functions as F

    plans, keep = [], el.stored
    monkeypatch.setattr(el, "stored", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df))
    repeated = ledger([event(idempotency_key="k"), event(idempotency_key="k", payload={}), event(actor="bob", channel="d")])
    lines = [*repeated[:2], dict(repeated[2], prev_hash="0" * 64), *thread(registry_version="v0")]
    rows = [("a", i, canon(e)) for i, e in enumerate(lines)] + [("cut", 0, "{")]
    df = spark.createDataFrame(rows, "ledger_id string, line_no long, line string")
    members = spark.createDataFrame([("ann", "c")], "actor_id string, channel string")
    cases = {
        el.CHAIN: el.chain_rules, el.IDENTITY: lambda e: el.identity_rules(e, registry[0], members), el.FORMS: lambda e: el.approval_form_rules(e, "v1"),
        el.AUTHORITY: lambda e: el.authority_rules(e, registry),
    }
    every = el.read(df)[1]
    for columns, rules in cases.items():
        plans.clear()
        e = el.read(df, columns)[1]
        assert e.columns == ["ledger_id", "position", *columns] and "sha2(" not in plans[0]
        assert sorted(map(tuple, rules(e).collect())) == sorted(map(tuple, rules(every).collect()))
    assert el.chain_rules(el.read(df, el.CHAIN)[1]).where(F.col("rule") == "double_processed").count() == 1
