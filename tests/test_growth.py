"""Work that grows with the rows, not with the size of a group."""

import hashlib

from pyspark.sql import functions as F

from memspark.operators import duplicates as dup


def test_names_with_a_common_beginning_are_no_candidates(spark):
    code = lambda i: hashlib.md5(str(i).encode()).hexdigest()[:10]
    rows = [(f"e{i}", "p", f"red bolt {code(i)}", "T") for i in range(2000)] + [("x", "p", f"red bolt {code(7)[:-2]}zz", "T"), ("y", "p", f"ed bolt {code(8)}", "T")]
    rows += [("l1", "p", "the long beginning of a name that goes on " + code(1), "T"), ("l2", "p", "the long beginning of a name that goes on " + code(1)[1:], "T")]
    named = spark.createDataFrame(rows, "id string, project string, name string, type string")
    able = named.select("project", "type", F.col("name").alias("key"), F.col("id").alias("rep"), F.char_length("name").alias("n"))
    assert dup._short_pairs(able, 2).count() < 200
    found = dup.flag_duplicates(named)
    assert {(r.source_id, r.target_id, r.confidence) for r in found.collect()} == {("e7", "x", 0.8), ("e8", "y", 0.9), ("l1", "l2", 0.9)}


def test_copies_of_a_place_do_not_meet(spark):
    from memspark.operators import views as vw

    spots = spark.range(4000).selectExpr("id", "concat('n', id) AS name", "'LOCATION' AS type", "'p' AS project", "double(id % 4) AS latitude", "double(id % 2) AS longitude", "double(id % 50) AS confidence")
    points = spark.range(400).selectExpr("id AS point_id", "double(id % 3) AS lat", "0D AS lon").union(spark.sql("SELECT 7L, 90D, 90D"))
    got = vw.locations_near_points(points, spots, 111, 5)
    rows, want = {}, {}
    for r in got.collect():
        rows.setdefault(r.point_id, []).append((r["rank"], r.location_id))
    known = spots.collect()
    for p in points.collect():
        near = [s for s in known if abs(s.latitude - p.lat) <= 1 and abs(s.longitude - p.lon) <= 1]
        best = sorted(near, key=lambda s: (-s.confidence, s.id))[:5]
        if best:
            want[p.point_id] = [(i + 1, s.id) for i, s in enumerate(best)]
    assert {k: sorted(v) for k, v in rows.items()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "latitude" in plan and "Aggregate [lat" in plan and plan.count("Window [row_number()") == 3


def test_a_large_limit_of_the_audit_is_not_held_by_one_task(spark):
    from memspark.operators import governance as gov

    audit = spark.range(30_000).selectExpr("lpad(id, 6, '0') AS id", "if(id % 100 = 0, NULL, timestamp_seconds(id % 977)) AS ts", "'a' AS actor", "'link' AS action", "'x' AS payload")
    order = [F.desc("ts"), F.desc("id")]
    for limit in (20_000, 29_900, 2**31 - 1):
        got = gov.audit_query(audit, limit=limit)
        assert "Limit" not in got._jdf.queryExecution().optimizedPlan().toString()
        assert [r.id for r in got.collect()] == [r.id for r in audit.orderBy(*order).collect()[:limit]]
    assert [r.id for r in gov.audit_query(audit, limit=30).collect()] == [r.id for r in audit.orderBy(*order).limit(30).collect()]


def test_sentences_of_one_file_are_dealt_over_the_cores(spark, sf_dir):
    from memspark.plans import load_registry

    for name in ("entity_merge", "relations_or_cooccur"):
        plan = load_registry()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "Repartition 8, true" in plan, name


def test_pieces_and_candidates_are_dealt_by_text(spark):
    from memspark.operators.matching import substring_pairs

    texts = spark.range(500).selectExpr("concat('red ring ', id) AS text")
    found = substring_pairs(spark.sql("SELECT explode(array('ring', 'ring 7', 'g 49')) AS needle"), texts)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression [text_key") >= 3
    assert {(r.needle, r.n) for r in found.groupBy("needle").agg(F.count("*").alias("n")).collect()} == {("ring", 500), ("ring 7", 11), ("g 49", 11)}


def test_neighbours_follow_edges_without_making_them_distinct(spark):
    from memspark.operators.graph import neighbours

    entities = spark.range(40).selectExpr("concat('e', id) AS id", "'p' AS project", "concat(if(id < 2, 'hub ', 'leaf '), id) AS name", "'T' AS type", "'' AS subtype", "1D AS confidence")
    edges = spark.range(3000).selectExpr("'p' AS project", "concat('e', if(id % 3 = 0, 0, 2)) AS source_id", "concat('e', 2 + id % 38) AS target_id")
    got = neighbours(spark.sql("SELECT 'q' AS query_id, '' AS project, 'hub' AS name"), entities, edges, limit=50)
    assert "Aggregate [project" not in got._jdf.queryExecution().optimizedPlan().toString() and "Aggregate [a#" not in got._jdf.queryExecution().optimizedPlan().toString()
    pairs = {(r.source_id, r.target_id) for r in edges.collect()}
    pairs |= {(b, a) for a, b in pairs}
    want = set()
    for start in ("e0", "e1"):
        one = {b for a, b in pairs if a == start}
        want |= {n for n in one | {b for a, b in pairs if a in one} if n != start}
    assert {r.id for r in got.collect()} == want


def test_texts_are_cut_once_for_a_search(spark):
    from memspark.operators.index import build_keyword_index
    from memspark.operators.search import bm25_search

    docs = spark.range(50).selectExpr("id AS doc_id", "concat('word', id % 7, ' other words') AS text")
    queries = spark.createDataFrame([("q", "", "word3 unknown")], "query_id string, project string, query string")
    hits = bm25_search(queries, build_keyword_index(docs, project_col=None))
    assert "Range (" not in hits._jdf.queryExecution().optimizedPlan().toString()
    assert [r.doc_id for r in hits.orderBy("rank").collect()] == [3, 10, 17, 24, 31, 38, 45]


def test_the_index_stream_holds_no_terms_of_many_documents(spark, tmp_path):
    from memspark.operators.index import build_keyword_index, index_unique
    from memspark.streaming.index import _newest

    docs = spark.sql("SELECT id AS doc_id, 'p' AS project, 1 AS ts, if(id = 3, NULL, concat('Words worded wording b7 ', id % 7, ' b7 words w', id % 5)) AS text FROM range(40)")
    rows = index_unique(docs, ["ts"])
    assert "Aggregate" not in rows._jdf.queryExecution().executedPlan().toString()
    want = build_keyword_index(docs).rows
    assert sorted(map(tuple, rows.drop("ts").collect())) == sorted(map(tuple, want.collect()))
    plan = _newest(rows.withColumn("version", F.lit("v")))._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_tiles_of_vectors_are_scored_one_by_one(spark):
    from memspark.operators.search import vector_search

    vectors = spark.range(60).selectExpr("id AS doc_id", "if(id % 2 = 0, 'p', 'q') AS project", "array(float(id), float(7), float(id % 5)) AS embedding")
    queries = vectors.where("doc_id < 9").selectExpr("doc_id AS query_id", "if(doc_id = 1, 'q', '') AS project", "embedding")
    got = vector_search(queries, vectors, limit=1, query_block=2, document_block=7)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and plan.count("MapInPandas") <= 2
    assert {r.query_id: r.doc_id for r in got.collect()} == {k: k for k in range(9)}


def test_the_sql_embedder_reads_texts_once(spark):
    from memspark.functions.vectors import hash_embedding_sparse

    docs = spark.createDataFrame([(1, "one two two"), (1, "two"), (2, None), (3, "...")], "doc_id long, text string")
    found = hash_embedding_sparse(docs, "doc_id", "text", 16)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("sha2") == 1
    raw = {}
    for word, n in (("one", 1), ("two", 3)):
        h = hashlib.sha256(word.encode()).hexdigest()
        raw[int(h[:8], 16) % 16] = raw.get(int(h[:8], 16) % 16, 0) + n * (1 if int(h[8], 16) % 2 else -1)
    norm = sum(v * v for v in raw.values()) ** 0.5
    assert {(r.doc_id, r.slot, round(r.weight, 9)) for r in found.collect()} == {(1, s, round(v / norm, 9)) for s, v in raw.items() if v}


def test_pairs_are_sorted_once_after_the_shuffle(spark):
    old = spark.range(50).selectExpr("'a' || id AS source_id", "'b' AS target_id", "0.5D AS confidence", "'exact' AS match_type", "'confirmed' AS status", "timestamp_seconds(id) AS created_at")
    out = dup.upsert_same_as(old, old.drop("status").withColumn("match_type", F.lit("fuzzy")))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("Exchange hashpartitioning") == 1
    assert out.where("match_type = 'fuzzy' AND status = 'confirmed' AND confidence = 0.5").count() == 50


def test_close_names_meet_in_few_groups_and_once(spark, monkeypatch):
    import itertools
    import random

    from memspark.operators import close_names
    from test_skew import edit_distance

    rnd, names = random.Random(11), set()
    for alphabet, size in (("ab", 9), ("0123456789", 7), ("aé字", 30), ("0123456789", 6)):
        for _ in range(90):
            near = list(rnd.choice(sorted(names))) if names and rnd.random() < 0.6 else [rnd.choice(alphabet) for _ in range(rnd.randint(3, size))]
            near[rnd.randrange(len(near))] = rnd.choice(alphabet)
            k = rnd.randint(0, len(near))
            near[k : k + rnd.randint(0, 1)] = rnd.choice(["", alphabet[0], alphabet[-2:]])
            names |= {"".join(near)[:34], "part " + "".join(near)[:7], "".join(near)[:9] + " part"}
    names = sorted(x for x in names if len(x) > 2)
    rows = [(f"e{k:04d}", "p" if k % 5 else "q", x, "T") for k, x in enumerate(names)]
    table = spark.createDataFrame([*rows, ("n1", None, names[0], "T"), ("n2", "p", None, "T"), ("n3", "p", "", "T")], "id string, project string, name string, type string")
    want = {(a, b, edit_distance(x, y)) for (a, p, x, _), (b, q, y, _) in itertools.combinations(rows, 2) if p == q and abs(len(x) - len(y)) < 3 and edit_distance(x, y) <= 2}
    able = table.selectExpr("project", "type", "name AS key", "id AS rep", "char_length(name) AS n").where("n > 2 AND project IS NOT NULL")
    short = {(a, b, d) for a, b, d in want if max(len(names[int(a[1:])]), len(names[int(b[1:])])) <= dup.SHORT_NAME}
    assert len(short) > 500
    monkeypatch.setattr(dup, "FEW_NAMES", 100)
    for keys_of_a_bucket in (close_names.GROUP_KEYS, 1500):
        monkeypatch.setattr(close_names, "GROUP_KEYS", keys_of_a_bucket)
        pairs = dup._short_pairs(able, 2)
        # Before, a name was a row for each text that it may become, and a pair came once for each that both may.
        assert "Generate" not in pairs._jdf.queryExecution().optimizedPlan().toString()
        assert sorted((min(r.rep, r.rep2), max(r.rep, r.rep2), r.dist) for r in pairs.collect()) == sorted(short)
    fuzzy = dup.flag_duplicates(table).where("match_type = 'fuzzy'").collect()
    assert sorted((r.source_id, r.target_id, round(10 - 10 * r.confidence)) for r in fuzzy) == sorted(want)
