"""The panel of what a document leaves out: the slots are put in order once, not once a query."""

from siftline.operators import assembly


def test_panel_equals_plain_python(spark):
    slots = [("s", e, k, f"t{e}{k}") for e in range(3) for k in range(4)]
    shown = {("p", "s", 0, 1), ("p", "s", 2, 3), ("q", "s", 1, 0)}
    scores = {("p", "s", 0, 1): 1.0, ("p", "s", 1, 2): 0.5, ("p", "s", 0, 3): 0.5, ("p", "s", 2, 2): 0.9, ("q", "s", 2, 0): 0.1, ("r", "s", 9, 9): 0.3}
    kinds = "section string, entry_index int, slot_index int"
    out = assembly.excluded_panel(
        spark.createDataFrame(slots, f"{kinds}, text string").repartition(3), spark.createDataFrame(sorted(shown), f"query_id string, {kinds}"), spark.createDataFrame([(*k, v) for k, v in scores.items()], f"query_id string, {kinds}, score double")
    )
    want = set()
    for q in "pqr":
        hidden = [s for s in slots if (q, *s[:3]) not in shown]
        hidden.sort(key=lambda s: (-scores.get((q, *s[:3]), -1.0), s[:3]))
        want |= {(q, *s, scores.get((q, *s[:3])), i) for i, s in enumerate(hidden)}
    got = [(r.query_id, r.section, r.entry_index, r.slot_index, r.text, r.score, r.place) for r in out.collect()]
    assert len(got) == len(want) and set(got) == want
    # queries and slots meet by a broadcast alone: no shuffle, sort or window holds their product
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" not in plan and plan.count("Window [row_number") <= 2
