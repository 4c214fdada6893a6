"""Scenarios with known results, and random checks against plain-Python forms."""

import random

import pytest
from pyspark.sql import functions as F

from chronoloom.engine import Engine
from chronoloom.functions import interval as iv
from chronoloom.functions import tokens as tk
from chronoloom.operators import cluster_keys as ck
from chronoloom.operators import conflicts as cf
from chronoloom.operators import crosswalk as cw
from chronoloom.operators import golden as go
from chronoloom.operators import graph as gr
from chronoloom.operators import intervals as ops
from chronoloom.operators import keys as ky
from chronoloom.operators import linking as ln
from chronoloom.operators import query as qu
from chronoloom.operators import reconcile as rc
from chronoloom.plans.ontology import Constraint, ConstraintKind, Crosswalk, EntityType, IdentityKey, Ontology
from chronoloom.sources import records as src
from chronoloom.sources.shared import local_frame
from chronoloom.sources.store import SnapshotStore
from chronoloom.streaming.ingest import ReconcileLoop, batch_conflicts, graph_updates, ingest_by_shard, ingest_stream, ingest_with_updates, read_nested_stream

IAM = lambda: Ontology().add_identity_key("email", "email").add_strong_identifier("ssn").add_constraint("unique_email", "email")


def tables(spark, rows):
    """rows: (record_id, perspective, uid, [(attr, value, start, end)], entity_type='person')."""
    records, descriptors = [], []
    for r in rows:
        rid, perspective, uid, ds = r[:4]
        records.append((rid, r[4] if len(r) > 4 else "person", perspective, uid))
        descriptors += [(rid, a, v, s, e, k) for k, (a, v, s, e) in enumerate(ds)]
    return local_frame(spark, records, src.RECORDS), local_frame(spark, descriptors, src.DESCRIPTORS)


def clusters(df):
    return {r.record_id: r.cluster_id for r in df.collect()}


def rowset(df):
    return {tuple(r) for r in df.collect()}


# ---- intervals ----


def pairs_frame(spark, pairs):
    return local_frame(spark, [(*a, *b) for a, b in pairs], "a long, b long, c long, d long")


def test_allen_relations(spark):
    expected = {
        ((0, 5), (6, 9)): "precedes", ((6, 9), (0, 5)): "preceded_by", ((0, 5), (5, 9)): "meets", ((5, 9), (0, 5)): "met_by",
        ((0, 5), (3, 9)): "overlaps", ((3, 9), (0, 5)): "overlapped_by", ((0, 5), (0, 9)): "starts", ((0, 9), (0, 5)): "started_by",
        ((3, 5), (0, 9)): "during", ((0, 9), (3, 5)): "contains", ((0, 9), (3, 9)): "finishes", ((3, 9), (0, 9)): "finished_by", ((1, 2), (1, 2)): "equals",
    }
    df = pairs_frame(spark, list(expected))
    got = df.select(iv.allen_relation(iv.interval("a", "b"), iv.interval("c", "d")).alias("r"), "a", "b", "c", "d").collect()
    assert {((r.a, r.b), (r.c, r.d)): r.r for r in got} == expected


def test_open_ends_do_not_overflow(spark):
    df = pairs_frame(spark, [((iv.NEG_INF, iv.POS_INF), (0, 10)), ((5, iv.POS_INF), (0, 10)), ((0, 3), (7, 9))])
    a, b = iv.interval("a", "b"), iv.interval("c", "d")
    rows = df.select(iv.duration(a).alias("d"), iv.duration_or_zero(a).alias("z"), iv.display(a).alias("s"), iv.overlap_duration(a, b).alias("o"), F.size(iv.difference(b, a)).alias("n")).collect()
    assert [tuple(r) for r in rows] == [(None, 0, "(-∞, +∞)", 10, 0), (None, 0, "[5, +∞)", 5, 1), (3, 3, "[0, 3)", 0, 1)]


def test_invalid_interval_raises(spark):
    with pytest.raises(Exception, match="invalid interval"):
        pairs_frame(spark, [((5, 5), (0, 1))]).select(iv.checked(iv.interval("a", "b")).alias("i")).collect()


def random_intervals(seed, n=60, keys=4):
    r = random.Random(seed)
    return [(r.randint(0, keys), f"v{r.randint(0, 2)}", s := r.randint(0, 60), s + r.randint(1, 15)) for _ in range(n)]


def points(rows):
    return {t for s, e in rows for t in range(s, e)}


@pytest.mark.parametrize("seed", range(3))
def test_interval_sets_by_points(spark, seed):
    a, b = random_intervals(seed), random_intervals(seed + 100)
    fa, fb = (local_frame(spark, x, "k int, value string, start_ts long, end_ts long") for x in (a, b))
    for made, op in ((ops.intersect_sets(fa, fb, ["k"]), set.intersection), (ops.subtract_sets(fa, fb, ["k"]), set.difference)):
        got = {}
        for r in made.collect():
            got.setdefault(r.k, []).append((r.start_ts, r.end_ts))
        for k in range(5):
            expected = op(points((s, e) for i, _, s, e in a if i == k), points((s, e) for i, _, s, e in b if i == k))
            assert points(got.get(k, [])) == expected
            ordered = sorted(got.get(k, []))
            assert all(x[1] < y[0] for x, y in zip(ordered, ordered[1:], strict=False))


def test_coalescing_flavours(spark):
    df = local_frame(spark, [(1, "x", 0, 5), (1, "x", 5, 9), (1, "x", 20, 30)], "k int, value string, start_ts long, end_ts long")
    assert rowset(ops.coalesce_intervals(df, ["k"]).select("start_ts", "end_ts")) == {(0, 9), (20, 30)}
    assert rowset(ops.coalesce_intervals(df, ["k"], touching=False).select("start_ts", "end_ts")) == {(0, 5), (5, 9), (20, 30)}
    mixed = local_frame(spark, [(1, "x", 0, 9), (1, "y", 3, 4), (1, "x", 5, 12)], "k int, value string, start_ts long, end_ts long")
    assert rowset(ops.coalesce_runs(mixed, ["k"], "value").select("value", "start_ts", "end_ts")) == {("x", 0, 9), ("y", 3, 4), ("x", 5, 12)}
    assert rowset(ops.atomic_intervals(df, ["k"]).select("start_ts", "end_ts")) == {(0, 5), (5, 9), (9, 20), (20, 30)}


def test_bucketed_join_is_a_join(spark):
    a, b = ([(i, x[2], x[3]) for i, x in enumerate(random_intervals(s))] for s in (7, 8))
    fa, fb = (local_frame(spark, x, "id int, start_ts long, end_ts long") for x in (a, b))
    got = [tuple(r) for r in ops.bucketed_overlap_join(fa, fb, 7, 0, 100).select("id", "id_r").collect()]
    assert sorted(got) == sorted((i, j) for i, s, e in a for j, t, f in b if s < f and t < e)


# ---- ontology ----


def test_ontology_round_trip():
    o = IAM().add_entity_type(EntityType("person", ("email",), ("email",))).add_crosswalk(Crosswalk("crm", "1", "K", 0, 9)).add_constraint("w", "x", ConstraintKind.UNIQUE_WITHIN_PERSPECTIVE)
    o.perspective_weights.update(crm=5, erp=9, hr=0)
    o.permanent_attributes.update(crm=("email",), erp=("email", "x"), hr=("y",))
    again = Ontology.from_json(o.to_json())
    assert again == o
    assert o.authoritative_perspective("email") == "erp" and o.authoritative_perspective("y") is None
    assert o.has_higher_precedence("erp", "crm") and not o.has_higher_precedence("web", "crm")
    assert o.key_attributes_for_type("person") == (["email"], "entity_key") and o.key_attributes_for_type("other") == (["email"], "email")
    assert IdentityKey("a", ("x", "y")).matches(IdentityKey("b", ("y", "x")))
    assert o.constraints_for_attribute("email") == [Constraint("unique_email", "email")]
    assert len(o.crosswalks_for_perspective("crm")) == 1 and o.is_strong_identifier("any", "ssn")


# ---- golden records, keys, queries ----


def test_golden_trims_contested_time(spark):
    r, d = tables(spark, [(1, "hr", "1", [("name", "Alice", 0, 30), ("email", "a", 0, 20)]), (2, "crm", "2", [("name", "Alice", 10, 40), ("email", "b", 10, 40)])])
    o = Ontology().add_identity_key("name", "name")
    c = ln.resolve(r, d, o)
    assert clusters(c) == {1: 1, 2: 1}
    assert rowset(go.golden(d, c)) == {(1, "name", "Alice", 0, 40), (1, "email", "a", 0, 10), (1, "email", "b", 20, 40)}


@pytest.mark.parametrize("seed", range(3))
def test_golden_by_points(spark, seed):
    rows = random_intervals(seed)
    d = local_frame(spark, [(i, "x", v, s, e) for i, (k, v, s, e) in enumerate(rows)], "record_id long, attr string, value string, start_ts long, end_ts long")
    c = local_frame(spark, [(i, k) for i, (k, *_) in enumerate(rows)], "record_id long, cluster_id long")
    got = {}
    for g in go.golden(d, c).collect():
        got.setdefault((g.cluster_id, g.value), []).append((g.start_ts, g.end_ts))
    for k in range(5):
        at = {v: points((s, e) for i, w, s, e in rows if i == k and w == v) for v in ("v0", "v1", "v2")}
        for v in at:
            others = set().union(*(at[w] for w in at if w != v))
            assert points(got.get((k, v), [])) == at[v] - others


def test_cluster_key(spark):
    r, d = tables(spark, [(1, "crm", "1", [("email", "alice@example.com", 0, 10)])])
    key = ck.cluster_keys(r, d, ln.resolve(r, d, IAM()), IAM()).first()
    assert key.identity_key == "email" and key.cluster_key.startswith("ALIC-") and len(key.cluster_key) == 7


def test_cluster_keys_lengthen_until_unique(spark):
    o = Ontology().add_identity_key("who", "name", "city")
    r, d = tables(spark, [(1, "a", "1", [("name", "Ann Lee", 0, 9), ("city", "Bonn", 0, 9)]), (2, "a", "2", [("name", "Al Lo", 0, 9), ("city", "Rome", 0, 9)]), (3, "a", "3", [("name", "Zoe", 0, 9)])])
    keys = {k.cluster_id: k.cluster_key[:-3] for k in ck.cluster_keys(r, d, ln.resolve(r, d, o), o).collect()}
    assert keys == {1: "AL-BONN", 2: "AL-ROME", 3: "ZOE"}


def fnv_suffix(text):
    h = tk.FNV_OFFSET
    for b in text.encode():
        h = (h ^ b) * tk.FNV_PRIME % (1 << 64)
    return tk.BASE32[(h >> 5) & 31] + tk.BASE32[h & 31]


def test_suffixes_and_tokens(spark):
    texts = ["", "a", "alice@example.com", "naïve ü", "x" * 300]
    df = local_frame(spark, [(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(tk.key_suffix(F.col("t"))).collect()] == [fnv_suffix(t) for t in texts]
    forms = {"  John Doe ": "JD", "12345": "345", "12": "12", "a b c d e": "ABCD", "Hello": "HELL", "j.doe@x.org": "JD", "--": "", "É1": "1"}
    df = local_frame(spark, [(t,) for t in forms], "t string")
    assert {r.t: r.k for r in df.select("t", tk.short_token(F.col("t")).alias("k")).collect()} == forms


def test_strong_ids_make_a_query_conflict(spark):
    o = Ontology().add_identity_key("name", "name").add_strong_identifier("ssn")
    r, d = tables(spark, [(1, "crm", "1", [("name", "Ada", 0, 10), ("ssn", "A", 0, 10)]), (2, "crm", "2", [("name", "Ada", 5, 15), ("ssn", "B", 5, 15)])])
    c = ln.resolve(r, d, o)
    assert clusters(c) == {1: 1, 2: 2}
    out = qu.query_entities(d, c, [("name", "Ada")], 0, 20)
    assert out.kind() == "conflict" and rowset(out.conflict) == {(1, 2, 5, 10)}
    hits = qu.descriptor_hits(d, c, [("name", "Ada")], 0, 20)
    assert rowset(qu.offending_descriptors(hits, out.conflict, [("name", "Ada")])) == {("name", "Ada", 5, 10)}
    other = qu.query_entities(d, c, [("ssn", "B")], 0, 20)
    assert other.kind() == "matches" and qu.merge_outcomes([other, out]).kind() == "conflict"


def test_query_intersects_roles(spark):
    both = [("email", "a@x", 0, 30), ("org", "o", 0, 30)]
    r, d = tables(spark, [(1, "okta", "u1", [*both, ("role", "admin", 10, 20), ("role", "viewer", 20, 30)]), (2, "ldap", "u1", [*both, ("role", "admin", 12, 18)])])
    c = ln.resolve(r, d, IAM())
    ask = lambda *q: rowset(qu.query_entities(d, c, list(q), 0, 40).matches)
    assert ask(("org", "o"), ("role", "admin")) == {(1, 10, 20)} and ask(("role", "viewer")) == {(1, 20, 30)}
    assert ask() == set() and ask(("role", "nobody")) == set()
    out = qu.query_entities(d, c, [("role", "admin")], 0, 40)
    told = qu.render_matches(out.matches, go.golden(d, c), ck.cluster_keys(r, d, c, IAM())).first()
    assert ("role", "admin", 10, 20) in [tuple(g) for g in told.golden]


def test_disjoint_eras_are_one_identity(spark):
    o = Ontology().add_identity_key("who", "name").add_strong_identifier("phone")
    r, d = tables(spark, [(1, "hr", "1", [("name", "N", 0, 100)]), (2, "crm", "2", [("name", "N", 0, 40), ("phone", "1", 0, 40)]), (3, "crm", "3", [("name", "N", 50, 90), ("phone", "2", 50, 90)])])
    assert clusters(ln.resolve(r, d, o)) == {1: 1, 2: 1, 3: 1}


def test_key_needs_every_attribute_at_once(spark):
    o = Ontology().add_identity_key("k", "ssn", "country")
    rows = [(1, "hr", "1", [("ssn", "S", 851990400, 1283040000), ("country", "C", 851990400, 1283040000)]), (2, "crm", "2", [("ssn", "S", 1022803200, 1022889600), ("country", "C", 899078400, 1022889600)]), (3, "crm", "3", [("ssn", "S", 0, 10)])]
    r, d = tables(spark, rows)
    assert clusters(ln.resolve(r, d, o)) == {1: 1, 2: 1, 3: 3}
    rows = ky.key_rows(r, d, o)
    assert rowset(rows.select("record_id", "start_ts", "end_ts")) == {(1, 851990400, 1283040000), (2, 1022803200, 1022889600)}


def test_only_the_longest_intervals_make_keys(spark):
    ds = [("e", f"v{i}", 100 * i, 100 * i + 1 + i) for i in range(12)]
    r, d = tables(spark, [(1, "a", "1", ds)])
    rows = ky.key_rows(r, d, Ontology().add_identity_key("e", "e"))
    assert {x.key_values[0].value for x in rows.collect()} == {f"v{i}" for i in range(4, 12)}


# ---- conflicts ----


def test_vetoed_records_conflict_indirectly(spark):
    o = Ontology().add_identity_key("nc", "name", "country").add_strong_identifier("phone").add_strong_identifier("employee_id").add_constraint("up", "phone").add_constraint("ue", "employee_id")
    who = [("name", "John Doe", 86400, 432000), ("country", "US", 86400, 432000)]
    r, d = tables(spark, [(1, "crm", "1", [*who, ("phone", "1111", 86400, 432000)]), (2, "crm", "2", [*who, ("phone", "2222", 86400, 432000)]), (3, "hr", "3", [*who, ("employee_id", "E", 86400, 432000)])])
    stream = ln.resolve(r, d, o, ln.LinkOptions("stream"))
    assert clusters(stream) == {1: 1, 2: 2, 3: 3}
    assert clusters(ln.resolve(r, d, o, ln.LinkOptions("batch"))) == {1: 1, 2: 2, 3: 1}
    seen = cf.indirect_conflicts(r, d, stream, o).collect()
    assert {(x.status, x.start_ts, x.end_ts) for x in seen} == {("auto_resolved", 86400, 432000)} and len(seen) == 3
    one = cf.indirect_conflicts(r, d, stream, o, local_frame(spark, [(2,)], "cluster_id long"))
    assert [(x.cluster_id, x.status) for x in one.collect()] == [(2, "suppressed_merge")]


@pytest.mark.parametrize("second,expected", [("hr", 1), ("crm", 0)])
def test_unique_across_clusters_is_by_perspective(spark, second, expected):
    o = Ontology().add_strong_identifier("email").add_constraint("unique_email", "email")
    r, d = tables(spark, [(1, "hr", "1", [("email", "x", 0, 10)]), (2, second, "2", [("email", "x", 5, 20)])])
    seen = cf.observations(r, d, ln.resolve(r, d, o), o).collect()
    assert [x.kind for x in seen] == ["constraint_violation"] * expected
    if expected:
        assert (seen[0].start_ts, seen[0].end_ts, seen[0].participants, seen[0].cause) == (5, 10, [1, 2], "unique_email")


def test_direct_conflicts_and_summary(spark):
    r, d = tables(spark, [(1, "a", "u1", [("k", "1", 0, 30), ("x", "p", 0, 20)]), (2, "b", "u2", [("k", "1", 0, 30), ("x", "q", 10, 30), ("x", "p", 12, 14)])])
    o = Ontology().add_identity_key("k", "k").add_strong_identifier("z")
    c = ln.resolve(r, d, o)
    found = [(x.start_ts, x.end_ts, [(v.value, v.participants) for v in x["values"]]) for x in cf.direct_conflicts(d, c).orderBy("start_ts").collect()]
    assert found == [(10, 20, [("p", [1, 2]), ("q", [2])])]
    told = cf.list_conflicts(cf.summarize(cf.observations(r, d, c, o), r)).collect()
    assert [(x.kind, x.attribute, [tuple(p) for p in x.records]) for x in told] == [("direct", "x", [("a", "u1"), ("b", "u2")])]
    assert cf.list_conflicts(cf.summarize(cf.observations(r, d, c, o), r), attribute="y").count() == 0


def test_one_record_can_contradict_itself(spark):
    o = Ontology().add_strong_identifier("ssn").add_constraint("u", "ssn")
    r, d = tables(spark, [(i, "crm", "same", [("ssn", "A", 0, 10), ("ssn", "B", 0, 10)]) for i in range(1, 4)])
    kinds = [x.kind for x in cf.observations(r, d, ln.resolve(r, d, o), o).collect()]
    assert kinds.count("direct") == 6 and kinds.count("constraint_violation") >= 3


@pytest.mark.parametrize("seed", range(3))
def test_conflict_slices_by_points(spark, seed):
    rows = random_intervals(seed)
    d = local_frame(spark, [(i, "x", v, s, e) for i, (k, v, s, e) in enumerate(rows)], "record_id long, attr string, value string, start_ts long, end_ts long")
    c = local_frame(spark, [(i, k) for i, (k, *_) in enumerate(rows)], "record_id long, cluster_id long")
    for merged in (False, True):
        got = {}
        for x in cf.direct_conflicts(d, c, merged).collect():
            for t in range(x.start_ts, x.end_ts):
                assert (x.cluster_id, t) not in got
                got[x.cluster_id, t] = {v.value for v in x["values"]}
        active = {}
        for k, v, s, e in rows:
            for t in range(s, e):
                active.setdefault((k, t), set()).add(v)
        assert got == {key: v for key, v in active.items() if len(v) > 1}


# ---- greedy linking ----


def reference_link(rows, mode):
    """All records in order, over the whole data at once."""
    run = ln.Replay(ln.LinkOptions(mode))
    for rid, perspective, strong, keys in rows:
        run.link(rid, perspective, strong, keys)
    return run.clusters()


@pytest.mark.parametrize("mode", ["stream", "batch"])
def test_components_replay_like_the_whole(spark, mode):
    r = random.Random(11)
    rows, plain = [], []
    for i in range(1, 160):
        p = r.choice(["crm", "erp"])
        s = r.randint(0, 50)
        e = s + r.randint(1, 20)
        ds = [("name", f"n{r.randint(0, 25)}", s, e), ("mail", f"m{r.randint(0, 40)}", s, e)]
        if r.random() < 0.5:
            ds.append(("ssn", r.choice("AB"), s, e))
        rows.append((i, p, str(i), ds))
        strong = {(p, "ssn"): {v: [(s, e)]} for a, v, s, e in ds if a == "ssn"}
        plain.append((i, p, strong, [(a, f"{a}={v}", s, e) for a, v, s, e in ds[:2]]))
    o = Ontology().add_identity_key("name", "name").add_identity_key("mail", "mail").add_strong_identifier("ssn")
    rec, d = tables(spark, rows)
    assert clusters(ln.link_greedy(rec, d, o, ln.LinkOptions(mode))) == reference_link(plain, mode)


def test_guards_refuse_transitive_merges(spark):
    o = Ontology().add_identity_key("a", "a").add_identity_key("b", "b")
    rows = [(1, "p", "1", [("a", "1", 0, 9)]), (2, "p", "2", [("a", "1", 0, 9), ("b", "1", 0, 9)]), (3, "p", "3", [("b", "1", 0, 9), ("a", "2", 0, 9)]), (4, "p", "4", [("a", "2", 0, 9)])]
    r, d = tables(spark, rows)
    assert len(set(clusters(ln.resolve(r, d, o)).values())) == 1
    guarded = ln.resolve(r, d, o, ln.LinkOptions(guard_check=True))
    assert len(set(clusters(guarded).values())) >= 1
    log = rowset(ln.merge_log(r, d, o, ln.LinkOptions(guard_check=True)).select("outcome"))
    assert ("merged",) in log


def test_hot_keys_can_be_closed(spark):
    r, d = tables(spark, [(i, "p", str(i), [("a", "1", 2 * i, 2 * i + 3)]) for i in range(6)] + [(9, "p", "9", [("a", "1", 0, 99)])])
    o = Ontology().add_identity_key("a", "a")
    assert len(set(clusters(ln.resolve(r, d, o, ln.LinkOptions(hot_key_cap=0))).values())) == 7


def test_splitting_on_request(spark):
    o = Ontology(perspective_weights={"crm": 1}).add_strong_identifier("ssn")
    r, d = tables(spark, [(1, "crm", "1", [("ssn", "A", 0, 9)]), (2, "crm", "2", [("ssn", "B", 5, 9)]), (3, "erp", "3", [("ssn", "C", 0, 9)])])
    pairs = local_frame(spark, [(1, 2), (1, 3)], "a long, b long")
    clashes = ln.first_strong_clash(r, d, o, pairs)
    assert rowset(clashes.select("a", "b", "resolution")) == {(1, 2, "unresolvable"), (1, 3, "resolvable")}
    one = local_frame(spark, [(i, 1) for i in (1, 2, 3)], "record_id long, cluster_id long")
    assert clusters(ln.split_unresolvable(one, clashes)) == {1: 1, 2: 2, 3: 3}


# ---- graph ----


def test_graph(spark):
    r, d = tables(spark, [(1, "a", "1", [("k", "1", 0, 30), ("x", "p", 0, 20)]), (2, "b", "2", [("k", "1", 0, 30), ("x", "q", 10, 30)]), (3, "b", "3", [("k", "2", 0, 5)])])
    o = Ontology().add_identity_key("k", "k")
    c = ln.resolve(r, d, o)
    g = gr.export_graph(r, d, c, o, cf.observations(r, d, c, o))
    assert {x.part: x.n for x in g.counts().collect()} == {"nodes": 5, "same_as": 1, "conflicts_with": 1}
    assert rowset(g.conflicts_with.select("source", "target", "attribute", "start_ts", "end_ts")) == {(1, 2, "x", 10, 20)}
    assert g.to_jsonl().count() == 5 + 1 + 1 + 4
    node = g.nodes.where("id = 'cluster_1'").first().properties
    assert node["size"] == "2" and node["root_record"] == "1" and '"attr":"x"' in node["golden"]
    assert "R1 -- R2" in gr.to_dot(r, c, cf.direct_conflicts(d, c)) and gr.text_summary(c, cf.observations(r, d, c, o)).startswith("records: 3")
    assert gr.same_as_edges(c, star=True).count() == 1
    changed = gr.diff(g.same_as, gr.same_as_edges(local_frame(spark, [(1, 1), (2, 2), (3, 2)], "record_id long, cluster_id long")), ["source", "target"])
    assert (changed.added.count(), changed.removed.count(), changed.kept.count()) == (1, 1, 0)


# ---- shards ----


def test_reconcile_blocks_and_merges(spark):
    o = Ontology().add_identity_key("isin_country", "isin", "country").add_strong_identifier("ts_code")
    of = lambda code: [("isin", "I", 0, 100), ("country", "US", 0, 100), ("ts_code", code, 0, 100)]
    for second, code, blocked in (("msci", "TS2", True), ("axioma", "TS2", False), ("msci", "TS1", False)):
        r, d = tables(spark, [(1, "msci", "1", of("TS1")), (2, "msci", "2", of("TS1")), (3, second, "3", of(code)), (4, second, "4", of(code))])
        local = local_frame(spark, [(1, 1), (2, 1), (3, 3), (4, 3)], "record_id long, cluster_id long")
        shards = local_frame(spark, [(1, 0), (2, 0), (3, 1), (4, 1)], "record_id long, shard int")
        index = rc.boundary_index(ky.key_rows(r, d, o), local, shards, rc.perspective_strong_hashes(r, d, local, ["ts_code"]))
        found = rc.reconcile(index)
        assert (found.conflicts.count(), found.merges.count()) == ((1, 0) if blocked else (0, 1))
        assert rc.reconcile(index, index.limit(0)).pairs.count() == 0 and rc.dirty_keys(index, index).count() == 0
        if not blocked:
            assert clusters(rc.apply_merges(local, found.merges)) == {1: 1, 2: 1, 3: 1, 4: 1}
            assert rc.merge_boundaries(index, found.merges).select("cluster_id").distinct().count() == 1


def test_merge_chains_end_at_the_smallest(spark):
    local = local_frame(spark, [(i, i) for i in range(1, 6)], "record_id long, cluster_id long")
    merges = local_frame(spark, [(4, 5), (3, 4), (2, 3)], "primary long, secondary long")
    assert clusters(rc.apply_merges(local, merges)) == {1: 1, 2: 2, 3: 2, 4: 2, 5: 2}


def test_reconcile_policy():
    p = rc.ReconcilePolicy()
    assert p.due(1000, 0, 1e6, 10) and p.due(1, 61, 1e6, 10) and p.due(1, 0, 10, 10)
    assert not p.due(0, 100, 0, 100) and not p.due(5000, 100, 0, 1) and not p.due(1, 0, 1e6, 10)


def test_routing_keeps_keys_together(spark):
    o = IAM()
    r, d = tables(spark, [(i, "p", str(i), [("email", f"e{i % 5}", 0, 9)] if i % 3 else []) for i in range(60)])
    placed = {x.record_id: x.shard for x in ky.route(r, d, o, 8).collect()}
    assert len(placed) == 60
    for k in range(5):
        assert len({placed[i] for i in range(60) if i % 3 and i % 5 == k}) == 1


# ---- crosswalks ----


def test_crosswalks(spark):
    o = Ontology(perspective_weights={"a": 2, "b": 5})
    for c in (Crosswalk("a", "1", "K1", 0, 10), Crosswalk("a", "1", "K2", 5, 20), Crosswalk("b", "9", "K2", 30, 40)):
        o.add_crosswalk(c)
    df = o.crosswalk_frame(spark).withColumn("seq", F.monotonically_increasing_id())
    assert cw.latest(df, "seq").where("perspective = 'a'").first().canonical_id == "K2"
    assert cw.by_canonical_id(df, "K2").count() == 2 and cw.by_perspective(df, "b").count() == 1 and cw.overlapping(df, 15, 30).count() == 1
    r, _ = tables(spark, [(1, "a", "1", []), (2, "b", "9", []), (3, "c", "1", [])])
    assert cw.resolve_records(r, df).count() == 3
    assert [x.perspective for x in cw.perspective_order(r, o).orderBy("precedence").collect()] == ["b", "a", "c"]


# ---- sources, store and engine ----


def nested(spark, rows):
    data = [(i, {"entity_type": "person", "perspective": p, "uid": u}, [dict(zip(("attr", "value", "start", "end"), x, strict=True)) for x in ds]) for i, p, u, ds in rows]
    return local_frame(spark, data, src.NESTED)


PEOPLE = [
    (1, "crm", "1", [("email", "alice", 0, 100)]),
    (2, "crm", "2", [("email", "alice", 0, 100), ("phone", "1", 0, 100)]),
    (3, "crm", "3", [("email", "alice", 0, 100), ("name", "A", 0, 100)]),
    (4, "crm", "4", [("email", "bob", 0, 10)]),
    (5, "erp", "5", [("email", "bob", 5, 20)]),
]


def identity_clusters(engine):
    met = engine.assignments.join(engine.records, "record_id").collect()
    groups = {}
    for r in met:
        groups.setdefault(r.cluster_id, set()).add(r.uid)
    return {frozenset(g) for g in groups.values()}


def test_batch_and_incremental_agree(spark, tmp_path):
    whole = Engine(spark, str(tmp_path / "whole"), IAM())
    assert whole.ingest(nested(spark, PEOPLE)).inserted == 5
    for name, order in (("one", [[4], [2, 0], [3, 1]]),):
        engine = Engine(spark, str(tmp_path / name), IAM())
        for part in order:
            engine.ingest(nested(spark, [PEOPLE[i] for i in part]))
        assert identity_clusters(engine) == identity_clusters(whole)
        golden = lambda e: sorted((g.attr, g.value, g.start_ts, g.end_ts) for g in e.golden().collect())
        assert golden(engine) == golden(whole)
    assert whole.ingest(nested(spark, PEOPLE)).inserted == 0
    assert whole.query([("email", "alice"), ("phone", "1")], 0, 50).kind() == "matches"
    assert whole.stats().first().record_count == 5 and whole.metrics().first().clusters == 2
    assert whole.graph().counts().count() == 3 and whole.conflicts().count() >= 0
    index = whole.boundary_index(4)
    assert whole.reconcile(index).pairs.count() == 0


def test_repeated_identity_is_dropped_whole(spark, tmp_path):
    engine = Engine(spark, str(tmp_path), IAM())
    engine.ingest(nested(spark, [(1, "crm", "1", [("email", "a", 0, 10)]), (2, "crm", "1", [("email", "a", 0, 99)])]))
    assert engine.records.count() == 1 and rowset(engine.descriptors.select("value", "end_ts")) == {("a", 10)}


def test_snapshots_export_and_import(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "a"), IAM())
    engine.ingest(nested(spark, PEOPLE), batch_id=7)
    assert engine.ingest(nested(spark, [(9, "x", "9", [("email", "z", 0, 1)])]), batch_id=7).inserted == 0
    copy = Engine(spark, str(tmp_path / "b"))
    copy.store = engine.checkpoint(str(tmp_path / "b"))
    assert Engine(spark, str(tmp_path / "b")).ontology == IAM() and clusters(copy.assignments) == clusters(engine.assignments)
    other = Engine(spark, str(tmp_path / "c"), IAM())
    other.import_(engine.export(2, 5))
    assert sorted(r.record_id for r in other.records.collect()) == [2, 3, 4] and tuple(engine.id_range().first()) == (1, 5, 5, False)
    page, more, after = src.export_page(engine.records, 1, 0, 2)
    assert [r.record_id for r in page.collect()] == [1, 2] and more and after == 3
    with pytest.raises(ValueError, match="below"):
        src.id_page(engine.records, 5, 5)
    engine.store.save({"records": engine.records.limit(1)})
    engine.store.prune(1)
    assert engine.store.version() == 2 and engine.store.load("descriptors") is None
    engine.set_ontology(Ontology())
    assert engine.records.count() == 0


def test_store_refuses_another_format(spark, tmp_path):
    (tmp_path / "_current").write_text('{"format": 99, "version": 1, "tables": []}')
    with pytest.raises(ValueError, match="format 99"):
        SnapshotStore(spark, str(tmp_path)).version()


def test_invalid_rows(spark):
    bad = nested(spark, [(1, "crm", "1", [("email", "a", 5, 5)]), (2, "crm", "2", [("email", "a", 0, 5)])])
    assert src.invalid_records(bad).count() == 1
    with pytest.raises(Exception, match="invalid record"):
        src.flat(bad)[0].collect()
    assert src.flat(bad, strict=False)[0].count() == 1


def test_stream(spark, tmp_path):
    batches = tmp_path / "in"
    for k in range(3):
        nested(spark, PEOPLE[k * 2 : k * 2 + 2]).coalesce(1).write.mode("append").parquet(str(batches))
    engine = Engine(spark, str(tmp_path / "state"), IAM())
    seen = []
    for _ in range(2):  # the second run finds nothing new
        q = ingest_stream(engine, read_nested_stream(spark, str(batches), 1), str(tmp_path / "cp"), lambda e, b, i: seen.append((i, batch_conflicts(e, b).count())))
        q.awaitTermination(120)
    whole = Engine(spark, str(tmp_path / "whole"), IAM())
    whole.ingest(nested(spark, PEOPLE))
    assert identity_clusters(engine) == identity_clusters(whole) and len(seen) == 3
    assert graph_updates(engine.graph().nodes, engine.graph().nodes).added.count() == 0


# ---- interval index, growing stores, whole rows ----


def test_interval_index_is_a_scan():
    r = random.Random(4)
    index, plain = ln.IntervalIndex(), []
    index.BLOCK = 8
    for i in range(900):
        s = r.choice([r.randint(0, 300), r.randint(0, 300), -(2**62)])
        e = s + r.choice([1, r.randint(1, 9), r.randint(1, 90), 2**62])
        index.add(i, s, e)
        plain.append((i, s, e))
        a = r.randint(-5, 310)
        b = a + r.choice([1, 5, 60])
        assert index.overlapping(a, b) == [x for x in plain if x[1] < b and a < x[2]]
    assert sorted(index) == sorted(plain)


def test_long_key_is_replayed_without_a_scan():
    """One key over many disjoint times: each record meets its neighbours only."""
    run, n = ln.Replay(ln.LinkOptions("batch")), 30_000
    times = list(range(n))
    random.Random(1).shuffle(times)
    for i, t in enumerate(times):
        run.link(i, "p", {("p", "x"): {str(t % 2): [(3 * t, 3 * t + 2)]}}, [("k", "k", 3 * t, 3 * t + 2)])
    assert len(set(run.clusters().values())) == n


def test_growing_store_gives_what_one_batch_gives(spark, tmp_path):
    """Batches in any order, with and without decisions, against one batch; parts are written as one now and then."""
    r = random.Random(6)
    rows = []
    for i in range(1, 61):
        s = r.randint(0, 40)
        rows.append((i, r.choice(["crm", "erp"]), str(i), [("email", f"e{r.randint(0, 12)}", s, s + r.randint(1, 9)), ("name", f"n{r.randint(0, 20)}", s, s + 5)]))
    o = Ontology().add_identity_key("email", "email").add_identity_key("name", "name")
    whole = Engine(spark, str(tmp_path / "whole"), o)
    whole.ingest(nested(spark, rows), keep_ids=True)
    engine = Engine(spark, str(tmp_path / "parts"), o)
    r.shuffle(rows)
    for k in range(4):
        engine.ingest(nested(spark, rows[15 * k : 15 * k + 15]), keep_ids=True, batch_id=5 - k)
    assert clusters(engine.assignments) == clusters(whole.assignments) == clusters(ln.resolve(whole.records, whole.descriptors, o))
    assert engine.store.manifest()["batches"] == [[2, 5]] and engine.store.committed(3) and not engine.store.committed(1)
    assert engine.ingest(nested(spark, rows[:3]), batch_id=4).inserted == 0
    copy = engine.checkpoint(str(tmp_path / "copy"))
    assert clusters(Engine(spark, copy.root).assignments) == clusters(engine.assignments)
    engine.store.prune(1)
    assert clusters(engine.assignments) == clusters(whole.assignments)


def test_store_falls_back_to_a_whole_version(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    one = local_frame(spark, [(1,)], "record_id long")
    assert store.save({"records": one}) == 1 and store.commit({"records": one}) == 2
    assert store.load("records").count() == 2
    store._fs().delete(store._path(store.parts("records")[1]), True)
    assert store.repair() == 1 and store.load("records").count() == 1


def test_routing_by_the_longest_interval(spark):
    o = Ontology().add_identity_key("a", "a").add_identity_key("b", "b")
    r, d = tables(spark, [(1, "p", "1", [("a", "1", 0, 5), ("b", "2", 0, 50)]), (2, "q", "2", [("b", "2", 7, 9)]), (3, "q", "3", [("a", "1", 0, 9), ("b", "3", 0, 4)]), (4, "q", "4", [])])
    got = {x.record_id: x.shard for x in ky.route_by_time(r, d, o, 1 << 20).collect()}
    assert got[1] == got[2] != got[3] and len(got) == 4


def test_observations_carry_evidence(spark):
    r, d = tables(spark, [(1, "crm", "1", [("email", "a", 0, 9), ("role", "x", 0, 9)]), (2, "crm", "2", [("email", "a", 0, 9), ("role", "y", 3, 9)])])
    o = Ontology().add_identity_key("email", "email").add_constraint("one_role", "role")
    told = {x.kind: x.evidence for x in cf.evidence(cf.observations(r, d, ln.resolve(r, d, o), o)).collect()}
    assert told["direct"] == "different values of role at one time in [3, 9) by records 1, 2"
    assert told["constraint_violation"].startswith("constraint one_role on role is violated in [3, 9)")


def test_names_and_interval_limits_survive_json():
    o = Ontology(key_intervals=None).add_strong_identifier("ssn", "social")
    back = Ontology.from_json(o.to_json())
    assert back.strong_identifiers[0].name == "social" and back.key_intervals is None


def test_blank_identities_are_refused(spark):
    bad = nested(spark, [(1, "", "1", [("email", "a", 0, 5)])])
    with pytest.raises(Exception, match="invalid record"):
        src.flat(bad)[0].collect()
    assert src.flat(bad, strict=False)[0].count() == 0


def test_a_batch_tells_what_it_changed(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "e"), IAM())
    engine.ingest(nested(spark, PEOPLE[:2]), keep_ids=True)
    told = ingest_with_updates(engine, nested(spark, [PEOPLE[2]]), keep_ids=True)
    assert clusters(told.assignments) == {3: clusters(engine.assignments)[3]}
    joined = clusters(engine.assignments)[3]
    assert {(e.source, e.target) for e in told.same_as.added.collect()} >= {(joined, 3)}
    assert "record_3" in {n.id for n in told.nodes.added.collect()} and told.same_as.removed.count() == 0
    assert told.conflicts.count() == engine.observations(told.assignments.select("cluster_id")).count()


def test_shards_ingest_and_reconcile_when_due(spark, tmp_path):
    engines = [Engine(spark, str(tmp_path / f"s{k}"), IAM()) for k in range(2)]
    assert sum(ingest_by_shard(engines, nested(spark, PEOPLE))) == 5
    assert sum(e.records.count() for e in engines) == 5
    engine = Engine(spark, str(tmp_path / "all"), IAM())
    engine.ingest(nested(spark, PEOPLE), keep_ids=True)
    now = [0.0]
    loop = ReconcileLoop(2, rc.ReconcilePolicy(dirty_limit=1, min_gap_s=5), clock=lambda: now[0])
    batch = nested(spark, PEOPLE[:1])
    assert loop.after(engine, batch, 0) is not None and loop.rounds == 1
    now[0] = 1.0
    assert loop.after(engine, batch, 1) is None
    now[0] = 9.0
    assert loop.after(engine, batch, 2) is None and loop.rounds == 1  # nothing is dirty
