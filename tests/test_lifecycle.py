"""Requests to answers as one plan: routes, scopes, and who asks the model."""

from dataclasses import replace

import pytest

from tessera.config import Generation
from tessera.operators import answer as A
from tessera.operators import lifecycle as L

HITS = "qid long, rank int, chunk_key long, content string, project string, build string, top_score double"
CHUNKS = "chunk_key long, chunk_id string, source_file string, target_file string, page int, heading_path string, content string"
PRODUCTS = "product string, revisions array<string>"
REQUESTS = "qid long, question string, project string, build string, task string, history string, recent string, prior_user boolean, cancelled boolean"


def stub():
    import re

    def model(prompts):
        out = []
        for p in prompts:
            if "Answer with the lines" in p:
                named = re.search(r"Question: (.*)", p).group(1)
                out.append(f"QUERY: {'better ' if 'better' in named else ''}{named}\nTASK: {'translate' if '翻译' in named else 'wiki'}\nPRODUCT: {'p2' if 'second' in named else 'none'}\nREVISION: none\nLAYER: none")
            elif p.startswith("Rewrite"):
                out.append("rewritten question")
            elif p.startswith("Name the task"):
                out.append("debug")
            else:
                out.append("" if "silent" in p else f"said {len(p)} [1]")
        return out

    return model


@pytest.fixture(scope="module")
def world(spark):
    chunks = spark.createDataFrame([(1, "a__s1", "data/raw/p1/b1/note/a.md", "data/processed/p1/b1/note/a.md", 0, "H", "Alpha text ![x](images/a/x.png)"), (2, "a__s1__w01", "data/raw/p1/b1/note/a.md", "data/processed/p1/b1/note/a.md", 0, "H", "more of it"), (3, "c__s1", "data/raw/p2/b2/note/c.md", "data/processed/p2/b2/note/c.md", 0, "", "Gamma")], CHUNKS)
    products = spark.createDataFrame([("p1", ["b1"]), ("p2", ["b2", "b20"])], PRODUCTS)
    return chunks, products


def run(spark, world, rows, config=None, expand=False):
    chunks, products = world
    asked = []

    def search(questions):
        asked.extend(r.asDict() for r in questions.collect())
        found = [(q["qid"], i + 1, k, t, "p1", "b1", -9.0 if "weak" in q["query"] else 1.0) for q in asked for i, (k, t) in enumerate([(1, "Alpha text ![x](images/a/x.png)"), (2, "more of it")]) if "nothing" not in q["query"]]
        return spark.createDataFrame(found, HITS)

    names = [c.split()[0] for c in REQUESTS.split(", ")]
    given = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], REQUESTS)
    made = L.answered(given, search, products, chunks, stub(), "T {{context}} | {{history}} | {{question}}", config, expand=expand)
    return {r.qid: r for r in made.collect()}, {q["qid"]: q for q in asked}


def test_routes_and_model_calls(spark, world):
    rows = [
        {"qid": 1, "question": "plain question of a wiki"}, {"qid": 2, "question": "gone", "cancelled": True}, {"qid": 3, "question": "  "}, {"qid": 4, "question": "x", "task": "translate", "history": "[User]:\nbefore"},
        {"qid": 5, "question": "翻译 this"}, {"qid": 6, "question": "weak one"}, {"qid": 7, "question": "weak one", "task": "debug"}, {"qid": 8, "question": "nothing here", "task": "debug"}, {"qid": 9, "question": "nothing here"}, {"qid": 10, "question": "silent model"},
    ]
    made, searched = run(spark, world, rows)
    assert {q: r.route for q, r in made.items()} == {1: "prepared", 2: "cancelled", 3: "empty", 4: "translation", 5: "translation", 6: "assistant", 7: "prepared", 8: "insufficient", 9: "assistant", 10: "prepared"}
    # The search sees what may need it, the preparing model what is open, the answering one what has a prompt.
    assert set(searched) == {1, 6, 7, 8, 9, 10}
    assert {q for q, r in made.items() if r.model_prepared} == {1, 5, 6, 7, 8, 9, 10}
    assert {q for q, r in made.items() if r.prompt is not None} == {1, 4, 5, 6, 7, 9, 10}
    assert made[8].answer == A.INSUFFICIENT and made[8].insufficient_context and made[2].answer == "" == made[3].answer
    assert made[10].answer == A.INSUFFICIENT and made[10].citations is None and not made[2].insufficient_context
    assert [c.chunk_id for c in made[1].citations] == ["a__s1", "a__s1__w01"] and made[6].citations is None
    assert "images/a/x.png" in made[1].answer and "Referenced Diagrams" in made[1].answer and made[7].task == "debug"


def test_scopes(spark, world):
    rows = [
        {"qid": 1, "question": "rails of p2 b20 board", "project": "p1", "build": "b1"}, {"qid": 2, "question": "rails of p2 b20 board"}, {"qid": 3, "question": "rails of the second"}, {"qid": 4, "question": "p1 common rules"},
        {"qid": 5, "question": "global better rules"}, {"qid": 6, "question": "no scope"}, {"qid": 7, "question": "p1 and second"},
    ]
    made, _ = run(spark, world, rows)
    got = {q: (r.target_project, r.target_build, r.query) for q, r in made.items()}
    assert got == {
        1: ("p1", "b1", "rails of p2 b20 board"), 2: ("p2", "b20", "rails of board"), 3: ("p2", None, "rails of the second"), 4: ("p1", "common", "rules"),
        5: ("global", "global", "better global better rules"), 6: (None, None, "no scope"), 7: ("p2", None, "and second"),
    }
    off, _ = run(spark, world, rows, Generation(scope_inference=False))
    assert {off[q].target_project for q in range(2, 8)} == {None} and off[2].query == "rails of p2 b20 board"


def test_separate_mode_and_everything_off(spark, world):
    rows = [{"qid": 1, "question": "and it?", "recent": "[User]: rail", "history": "[User]:\nrail", "prior_user": True}, {"qid": 2, "question": "a long question that stands alone, all by itself, with no help"}, {"qid": 3, "question": "it?", "task": "fa"}]
    made, _ = run(spark, world, rows, Generation(prepare="separate"))
    assert [(made[q].query, made[q].task, made[q].model_prepared) for q in (1, 2, 3)] == [("rewritten question", "debug", True), (rows[1]["question"], "debug", True), ("it?", "fa", False)]
    assert "rail" in made[1].prompt and "(none)" in made[2].prompt
    off, _ = run(spark, world, rows, Generation(query_rewrite=False, task_classification=False, scope_inference=False, assistant_fallback=False))
    assert not any(r.model_prepared for r in off.values()) and off[1].query == "and it?" and {r.route for r in off.values()} == {"prepared"}


def test_sections_expand(spark, world):
    made, _ = run(spark, world, [{"qid": 1, "question": "plain"}], expand=True)
    assert len(made[1].citations) == 1 and "Alpha text" in made[1].prompt and "more of it" in made[1].prompt and "[2]" not in made[1].prompt


def test_no_requests(spark, world):
    assert run(spark, world, [])[0] == {}


def test_thousands_are_one_plan(spark, world):
    rows = [{"qid": i, "question": f"question {i}", "cancelled": i % 10 == 0} for i in range(2000)]
    made, searched = run(spark, world, rows, replace(Generation(), task_classification=False, scope_inference=False))
    assert len(made) == 2000 and len(searched) == 1800 and sum(r.prompt is not None for r in made.values()) == 1800
