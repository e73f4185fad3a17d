import json
import random

from pyspark.sql import functions as F

from siftline.functions import stems
from siftline.functions.title import title_of
from siftline.operators import assembly, corpora, importer, models, retrieval, selection
from siftline.plans import selecting
from siftline.plans.config import Settings

VARIANTS = "array<struct<id:string,text:string,angles:array<string>,status:string,source:string,used_count:int,created_at:string>>"
MASTER = {
    "cv": {
        "sections": {
            "summary": ["Data engineer", "Backend developer"],
            "experience": [
                {"company": "Acme", "start_date": "2019-01", "achievements": [{"id": "a1", "facts": {"action": "Moved logs", "tools": ["Kafka"]}, "variants": [{"id": "v1", "text": "Moved logs to Kafka", "status": "approved", "angle": "scale"}, {"id": "v2", "text": "Secret", "status": "rejected"}]}]},
                {"company": "Beta", "start_date": "2021-05", "highlights": ["Wrote C++17 code", "Led a team", 5]},
            ],
            "skills": [{"label": "Languages", "details": "Python, C++"}],
        }
    }
}


def entries_of(spark, *docs):
    return corpora.entries(spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "doc int, text string"))


def test_stems_of_both_languages():
    assert [stems.english(w) for w in "running generously agreed relational skies communities hoping".split()] == "run generous agre relat sky communiti hope".split()
    assert [stems.spanish(w) for w in "corriendo trabajadores aplicaciones rápidamente nacionalidad cheques".split()] == "corr trabaj aplic rapid nacional chequ".split()
    assert stems.stem("next.js") == "next.js" and stems.stem("desarrollador") == "desarroll"


def test_titles(spark):
    cases = {
        "": "Oferta sin título",
        "\n  Buscamos un Backend Developer\nmore": "Backend Developer",
        "Acme Inc | Senior Data Engineer | Remote": "Senior Data Engineer",
        "We're hiring: the Platform Lead": "Platform Lead",
        "x" * 100: "x" * 80,
        "Remote | Madrid": "Remote | Madrid",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("i", title_of(F.col("t")).alias("title"))
    assert [r.title for r in df.orderBy("i").collect()] == list(cases.values())


def test_corpora_and_pieces(spark):
    found = entries_of(spark, MASTER)
    pieces = {(r.section, r.entry_index, r.field, r.item): r.text for r in corpora.pieces(found).collect()}
    assert pieces["summary", 1, None, None] == "Backend developer" and pieces["experience", 1, "highlights", 0] == "Wrote C++17 code"
    assert ("experience", 1, "highlights", 2) not in pieces and pieces["skills", 0, "details", None] == "Python, C++"
    report, check = corpora.report_corpus(found).first().corpus, corpora.check_corpus(found).first().corpus
    assert "kafka" not in report and "moved logs to kafka" in check and "secret" not in check and "acme" in report and "acme" not in check
    whole = corpora.whole_text(spark.createDataFrame([(0, json.dumps({"_x": "no", "a": ["Yes", {"b": "Too"}]})), (1, "broken{"), (2, None)], "doc int, text string"))
    assert {r.doc: r.corpus for r in whole.collect()} == {0: "yes \n too", 1: "", 2: ""}
    kinds = {r.section: r.kind for r in corpora.section_kinds(found).collect()}
    assert kinds == {"summary": "text", "experience": "entries", "skills": "label_details"}


def test_structure_rules(spark):
    bad = {"cv": {"sections": {"x": [
        {"name": "n", "highlights": ["a", {"b": 1}], "achievements": [{"id": "", "variants": []}, 3, {"id": "i", "variants": [{"id": "v", "text": " ", "status": "odd", "source": "odd", "used_count": -1, "angle": ["p", "q", "r"]}, 9]}]},
        {"achievements": "none"},
    ]}}}
    rules = {r.rule for r in corpora.structure_errors(entries_of(spark, bad), ["p", "q"]).collect()}
    assert len(rules) == 13 and "a variant has an unknown angle" in rules
    assert corpora.structure_errors(entries_of(spark, {"cv": {"sections": {"x": ["text", {"highlights": ["a"]}]}}}), []).count() == 0


def test_ranges_and_marks(spark):
    row = spark.createDataFrame([("abcabcab",)], "t string")
    pick = lambda c: [tuple(x) for x in row.select(c.alias("r")).first().r]
    terms = F.array(F.lit("abc"), F.lit("ca"), F.lit("zz"))
    assert pick(corpora.highlight_ranges(F.col("t"), terms)) == [(0, 7)]
    assert pick(corpora.marks(F.col("t"), terms)) == [(0, 3), (3, 6)]
    assert pick(corpora.occurrences(F.col("t"), F.lit("AB"))) == [(0, 2), (3, 5), (6, 8)]


def test_keyword_locations_and_channel(spark):
    found = corpora.pieces(entries_of(spark, MASTER))
    keywords = spark.createDataFrame([("c++", ["c++"]), ("kafka", ["kafka"]), ("python", ["py", "python"])], "keyword string, variants array<string>")
    where = {(r.keyword, r.section, r.field) for r in corpora.keyword_locations(keywords, found).collect()}
    assert where == {("c++", "skills", "details"), ("python", "skills", "details")}
    corpus = spark.createDataFrame([("s", 0, "vuelo rápido"), ("s", 1, "uses c++17 daily"), ("s", 2, "JavaScript and Node.js"), ("s", 3, "github  actions here"), ("s", 4, "next.jsx and github actionscript")], "section string, doc_id int, text string")
    asked = spark.createDataFrame([(1, "r", 1), (1, "c++", 2), (1, "js", 4), (1, "gh actions", 8), (1, "next.js", 16)], "query_id int, keyword string, freq int")
    got = {r.doc_id: r.score for r in retrieval.keyword_channel(corpus, asked).collect()}
    assert got == {1: 2.0, 2: 4.0, 3: 8.0}


def test_mmr_equals_a_plain_loop():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randint(1, 9)
        scores = sorted((rng.choice([0.1, 0.2, 0.5, 0.9]) for _ in range(n)), reverse=True)
        sets = [set(rng.sample("abcdef", rng.randint(0, 4))) for _ in range(n)]
        k, balance = rng.randint(1, 6), rng.choice([0.3, 0.7, 1.0])
        share = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
        if n <= k or balance >= 1:
            want = list(range(min(n, k)))
        else:
            want = [0]
            while len(want) < k:
                rest = [i for i in range(n) if i not in want]
                value = {i: balance * scores[i] / max(scores) - (1 - balance) * max(share(sets[i], sets[j]) for j in want) for i in rest}
                want.append(min(rest, key=lambda i: (-round(value[i], 12), i)))
            want = sorted(want)
        got = selection.mmr(scores, sets, k, balance)
        assert got == want


def test_global_swaps_bring_a_term_in():
    slot = lambda k, score, text, ranked=True: {"slot_index": k, "score": score, "text": text, "tokens": text.split(), "ranked": ranked}
    chosen = [{"section": "x", "entry_index": 0, "entry_score": 0.9, "shown": [0], "slots": [slot(0, 0.9, "python code")]}, {"section": "x", "entry_index": 1, "entry_score": 0.5, "shown": [0], "slots": [slot(0, 0.5, "sql")]}]
    spare = [{"section": "x", "entry_index": 2, "entry_score": 0.2, "shown": [0, 1, 2], "slots": [slot(0, 0.3, "plain"), slot(1, 0.25, "other"), slot(2, 0.1, "uses c++17")]}]
    out = selection.global_swaps(chosen, spare, {"c++": ["c++"], "python": ["python"]}, set(), 2)
    assert [e["entry_index"] for e in out] == [0, 2] and out[1]["shown"] == [0, 2] and out[1]["swap_step"] == 1
    assert [e["entry_index"] for e in selection.global_swaps(chosen, spare, {"c++": ["c++"]}, {"c++"}, 2)] == [0, 1]


def resume(spark):
    slots = [
        ("experience", 0, 0, "a1", None, [("v1", "Moved logs to Kafka with Python", ["scale"], "approved", "manual", 0, ""), ("v2", "Python pipelines in Kafka", ["impact"], "approved", "manual", 2, "")]),
        ("experience", 0, 1, None, "Answered phones", None),
        ("experience", 1, 0, None, "Cooked meals", None),
        ("experience", 2, 0, None, "Python services on Docker", None),
        ("projects", 0, 0, None, "Docker images for tests", None),
        ("skills", 0, 0, None, "Tools: Excel, Docker", None),
        ("skills", 1, 0, None, "Sports: chess", None),
        ("education", 0, 0, None, "Degree", None),
        ("education", 1, 0, None, "Docker course", None),
    ]
    table = spark.createDataFrame(slots, f"section string, entry_index int, slot_index int, ach_id string, text string, variants {VARIANTS}")
    dates = {0: "2018-01", 1: "2020-01", 2: "2019-06"}
    rows = [(s, f"{s}_{e}_{k}", e, k, t or v[0][1], dates.get(e) if s == "experience" else None) for s, e, k, _, t, v in slots]
    return table, spark.createDataFrame(rows, "section string, doc_id string, entry_index int, slot_index int, text string, start_date string")


def test_generation_end_to_end(spark):
    slots, corpus = resume(spark)
    more = [("summary", 0, 0, None, "Writes books"), ("summary", 1, 0, None, "Python and Kafka engineer"), ("languages", 1, 0, None, "English"), ("languages", 0, 0, None, "Spanish"), ("awards", 0, 0, None, "A prize"), ("awards", 0, 1, None, None)]
    slots = slots.unionByName(spark.createDataFrame([(*m, None) for m in more], slots.schema))
    queries = spark.createDataFrame([("q", "Requisitos: Python, Kafka and Docker. Docker daily.\nNo se requiere Excel.\n")], "query_id string, text string")
    lines, chosen, report, used = selecting.generate(corpus, slots, queries, Settings(use_reranker=False), manual=["Docker"], dictionary=["python", "kafka", "docker", "excel"])
    rows = lines.collect()
    by = {(r.section, r.entry_index): [x.text for x in sorted(rows, key=lambda x: x.out_pos) if (x.section, x.entry_index) == (r.section, r.entry_index)] for r in rows}
    assert {e for s, e in by if s == "experience"} == {0, 2}
    assert by["experience", 0][0] == "Python pipelines in Kafka"  # the representative wording
    assert by["skills", 0] == ["Tools: Docker, Excel"] and ("education", 0) in by
    line = next(r.text for r in rows if r.section == "keywords")
    assert line.startswith("Palabras clave: Docker") and "excel" not in line
    assert chosen.queries.first().negated == ["excel"]
    assert {r.variant_id: r.times for r in used.collect()} == {"v2": 1}
    assert by["summary", 1] == ["Python and Kafka engineer"] and ("summary", 0) not in by
    assert by["languages", 0] == ["Spanish"] and by["languages", 1] == ["English"] and by["awards", 0] == ["A prize"]
    assert report.first().score > 50 and chosen.mode == "positional_fallback"
    assert {r.entry_index for r in chosen.entries.where("section = 'experience' and included").collect()} == {0, 2}
    part, again = selecting.regenerate(corpus, slots, queries, "experience", Settings(use_reranker=False))
    assert {r.section for r in part.collect()} == {"experience"}
    seen = {r.keyword: r.in_master for r in selecting.preview(queries, corpus, ["python", "kafka", "rust"], ["go"]).collect()}
    assert seen["python"] and seen["kafka"] and not seen["go"]


def test_selection_with_models(spark):
    slots, corpus = resume(spark)
    queries = spark.createDataFrame([("q", "Docker and Python")], "query_id string, text string")
    encode = lambda texts: [[float("docker" in t.lower()), float("python" in t.lower()), 0.1] for t in texts]
    scorer = lambda q, t: t.str.contains("Docker").astype(float)
    chosen = selecting.select(corpus, queries, Settings(), encode=encode, model="e5", scorer=scorer)
    assert chosen.mode == "cross_encoder"
    top = chosen.ranked.where("section = 'experience' and rank = 0").first()
    assert top.entry_index == 2 and top.score == 0.731 and "docker" in top.reason


def test_assembly_falls_back_and_traces(spark):
    slots, _ = resume(spark)
    items = spark.createDataFrame([("q", "experience", 0, 0, [9], {}), ("q", "experience", 1, 99, [0], {}), ("q", "experience", 2, 2, [0, 0], {}), ("r", "experience", 0, 0, [1, 0], {0: "scale"})], "query_id string, section string, position int, entry_index int, slot_order array<int>, angles map<int,string>")
    lines = assembly.assembled(items, slots, 2, 2)
    got = sorted((r.query_id, r.place, r.out_pos, r.text) for r in lines.collect())
    assert got == [("q", 0, 0, "Python pipelines in Kafka"), ("q", 0, 1, "Answered phones"), ("q", 1, 0, "Python services on Docker"), ("r", 0, 0, "Answered phones"), ("r", 0, 1, "Moved logs to Kafka with Python")]
    assert {(r.query_id, r.variant_id, r.angle) for r in assembly.trace(lines).collect()} == {("q", "v2", "impact"), ("r", "v1", "scale")}
    more = assembly.with_entry(lines, slots, "r", "experience", 1)
    assert more.where("query_id = 'r' and entry_index = 1").first().text == "Cooked meals" and assembly.with_entry(more, slots, "r", "experience", 1).count() == more.count()
    longer = assembly.with_line(more, "r", "experience", 1, "Baked")
    assert longer.count() == more.count() + 1 and assembly.with_line(longer, "r", "experience", 1, "Baked").count() == longer.count()


def test_import_review(spark):
    labelled = spark.createDataFrame([(0, 0, "one", "f"), (1, 0, "two", "f"), (2, 2, "three", "g")], "id int, cluster int, text string, file string")
    bullets, groups, states = importer.session(labelled, "s")
    assert [(r.cluster_id, r.status) for r in states.collect()] == [("cl_0", "pending")] and [r.id for r in importer.orphans(groups).collect()] == [2]
    merged = importer.reviewed(groups, bullets, states, "cl_0", "merge").first()
    assert merged.status == "awaiting" and [v.text for v in merged.candidates[0].variants] == ["one", "two"]
    assert len(importer.reviewed(groups, bullets, states, "cl_0", "split").first().candidates) == 2
    assert importer.reviewed(groups, bullets, states, "cl_0", "discard").first().status == "done"
    chain = spark.createDataFrame([(i, i + 1) for i in range(70)], "a int, b int")
    nodes = spark.range(72).select(F.col("id").cast("int").alias("id"))
    assert {r.id: r.cluster for r in importer.clusters(nodes, chain).collect()} == {i: 0 if i < 71 else 71 for i in range(72)}


def test_model_flows(spark):
    texts = spark.createDataFrame([(1, "Cut costs 60% with Postgres"), (2, "")], "id int, text string")
    call = lambda system, user, schema: {"action": " Cut costs ", "tools": ["PostgreSQL", "Oracle"], "outcomes": [{"metric": "costs", "value": "-60%"}, {"metric": "x", "value": "y"}]}
    got = {r.id: r.facts for r in models.extracted(texts, call).collect()}
    assert got[1].action == "Cut costs" and got[1].tools == ["PostgreSQL"] and [tuple(o) for o in got[1].outcomes] == [("costs", "-60%")]
    assert models.extracted(texts, None).where("id = 1").first().facts.tools == []

    def broken(*_):
        raise ValueError("down")

    assert models.hypothetical(texts.withColumnRenamed("id", "query_id"), broken).where("answer is not null").count() == 0
    assert models.with_retry(broken, lambda *_: {"a": 1})("", "", {}) == {"a": 1}
    one = spark.createDataFrame([(1, ("Did", [], "", []), ["old text with Kafka"], "", "", "scale"), (2, ("", [], "", []), [], "", "", "scale"), (3, ("Did", [], "", []), [], "", "", "odd")], "id int, facts struct<action:string,tools:array<string>,scope:string,outcomes:array<struct<metric:string,value:string>>>, wordings array<string>, current string, snippet string, angle string")
    out = {r.id: r for r in models.reworded(one, lambda *_: {"text": "New", "tech_terms": ["Kafka", "Rust", "Rust"]}, ["scale"]).collect()}
    assert out[1].new_text == "New" and out[1].unverified_terms == ["Rust"] and out[1].error is None
    assert out[2].error == "nothing to reword" and out[3].error == "unknown angle: odd"
    entry = spark.createDataFrame([(1, "uses docker", "needs docker", "old", [0])], "id int, text string, query_text string, reason string, achievement_slots array<int>")
    say = lambda reason: lambda *_: {"match_reason": reason, "preferred_angles": [{"slot_index": 0, "angle": "scale"}, {"slot_index": 1, "angle": "scale"}]}
    assert models.strategic(entry, say("knows docker"), ["docker", "rust"], ["scale"]).first().reason == "knows docker"
    kept = models.strategic(entry, say("knows rust"), ["docker", "rust"], ["scale"]).first()
    assert kept.reason == "old" and kept.angles == {0: "scale"}
    story = spark.createDataFrame([("Built it", "Python", "")], "work string, tools string, outcomes string")
    assert models.structured(story, None).first().wording == "Built it Python"
    assert models.structured(story, lambda *_: {"facts": {"tools": ["Python", "Go"]}, "variant_text": "I built it"}).first().facts.tools == ["Python"]
