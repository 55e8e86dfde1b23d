"""run() against the stages spelled out in plain Python."""

import random

from tests.llm.test_matching import components, family, leaks, prose
from tests.llm.test_models import BAD

import corpus_pipeline
from plumbframe.llm import secrets, toxicity
from plumbframe.llm.common import table


def made():
    rnd = random.Random(4)
    items = [(i, " ".join(prose(rnd, 30, 5000))) for i in range(5)]
    texts = []
    for i in range(240):
        w = prose(rnd, rnd.randint(20, 60), 5000)
        if i % 7 == 0:
            w[3:3] = rnd.sample(BAD, 3)
        if i % 11 == 0:
            w += items[i % 5][1].split()
        if i % 13 == 0:
            w += ["token", "=", '"' + "".join(rnd.choice("0123456789abcdef") for _ in range(40)) + '"']
        texts.append(" ".join(w))
    texts += family(rnd, prose(rnd, 80, 5000), 12, 2) + [texts[1]] * 5 + ["", None]
    docs = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    labels = [(i, 1, int(any(b in (t or "") for b in BAD))) for i, t, *_ in docs if i % 2]
    return docs, labels, items


def test_pipeline(spark, tables):
    docs, labels, items = made()
    d = tables(documents=docs, labels=labels, benchmark=items)
    rows = corpus_pipeline.run(spark, d).collect()
    frame = table(spark, d, "documents")
    model = toxicity.fit_toxicity(frame, toxicity.training_labels(table(spark, d, "labels")))
    score = {r.doc_id: r.s for r in toxicity.score_toxicity(frame.select("doc_id", "text"), model, score="s").collect()}
    kept = [(i, t) for i, t, *_ in docs if score[i] < 0.3]
    assert not any(b in (t or "") for _, t in kept for b in BAD)
    of = components(kept, 5, 80)
    kept = [(i, t) for i, t in kept if of[i] == i]
    bad = leaks(kept, items)
    kept = [(i, t) for i, t in kept if (i, t) not in bad]
    texts = dict(kept)
    assert {r.doc_id for r in rows} <= set(texts) and len(rows) > 100
    for r in rows:
        assert r.text == texts[r.doc_id] or (secrets.REDACTED.decode() in r.text and r.n_chars == len(r.text) and 'token = "' not in r.text.replace('token = "[REDACTED]', ""))
    # Each source's words come near its target, and no document is taken more than twice.
    copies = {}
    for r in rows:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert max(copies.values()) <= 2
    taken, target = {}, {}
    for r in rows:
        taken[r.source] = taken.get(r.source, 0) + r.mix__size
        target[r.source] = r.mix__target
    for s, t in target.items():
        assert abs(taken[s] - t) < 0.3 * t


def test_stages_keep_their_columns(spark, tables):
    docs, labels, items = made()
    d = tables(documents=docs, labels=labels, benchmark=items)
    now = table(spark, d, "documents")
    names = now.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "mixing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, d)
        assert now.columns == names
    empty = tables(documents=[], labels=[], benchmark=[])
    assert corpus_pipeline.run(spark, empty).count() == 0
