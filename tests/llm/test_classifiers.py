"""Toxicity, language identification and chat formatting: held-out quality, and every edge case has its defined result."""

from __future__ import annotations

import random
import zlib

import pytest
from pyspark.sql import functions as F

from sensorgrid.llm import chat_format, language_id, toxicity


def crc(i):
    return zlib.crc32(("" if i is None else str(i)).encode())


def test_toxicity_of_held_out_documents(spark, documents, prose):
    bad, r = ["idiot", "moron", "worthless", "scum"], random.Random(1)
    rows, labels = [], []
    for i in range(500):
        words = prose(r.randint(20, 80), i).split(" ")
        toxic = i % 2
        if toxic:
            for _ in range(max(2, len(words) // 15)):
                words.insert(r.randrange(len(words)), r.choice(bad) if crc(i) % 3 != 1 else r.choice(["idiots", "morons", "worthlessly", "scums"]))
        rows.append((i, " ".join(words)))
        labels.append((i, toxic, "x"))
    table = spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    found = {x.doc_id: x for x in toxicity.train_and_score(documents(rows), table).collect()}
    held = [i for i, _ in rows if crc(i) % 3 == 1]
    assert all(found[i].held_out == (crc(i) % 3 == 1) for i, _ in rows)
    assert sum(found[i].predicted == i % 2 for i in held) >= 0.95 * len(held)


def test_toxicity_edge_cases(spark, documents, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    found = toxicity.train_and_score(documents(odd), none).collect()
    assert len(found) == len(odd) and all(x.score == 0 and x.predicted == 0 for x in found)
    some = spark.createDataFrame([(1, 1), (7, 0), (None, 1), (3, None), (5, 1), (5, 0)], "doc_id long, toxic int")
    found = toxicity.train_and_score(documents(odd), some).collect()
    assert len(found) == len(odd) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for x in found)
    assert toxicity.train_and_score(documents([]), some).count() == 0


def test_toxicity_sample_has_distinct_documents(spark, documents, prose, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_TOXIC", 8)
    monkeypatch.setattr(toxicity, "MAX_CLEAN", 8)
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda bags, toxic: seen.append(sorted(toxic.tolist())))
    ids = [i for i in range(60) if crc(i) % 3 != 1][:30]
    repeated = [(i, i % 2) for i in ids for _ in range(20)]
    missing = [(1000 + i, i % 2) for i in range(400)]
    both = [(i, 0) for i in ids if i % 2]
    table = spark.createDataFrame(repeated + missing + both, "doc_id long, toxic int")
    toxicity.train(documents([(i, prose(20, i)) for i in ids]), table)
    assert seen == [[0] * 8 + [1] * 8]


LANGS = {
    "en": "the and that with from which would there their about people these other because through".split(),
    "de": "der und nicht mit eine werden sich auch nach über können durch wenn schon zwischen".split(),
    "ru": "и не на что это как его для они был также после между человек время".split(),
}


def test_language_of_held_out_documents(spark, documents, prose):
    names, rows, langs = sorted(LANGS), [], {}
    for i in range(240):
        langs[i] = names[i % 3]
        rows.append((i, prose(5 + i % 60, i, LANGS[langs[i]])))
    found = {x.doc_id: x for x in language_id.train_and_predict(documents(rows, langs)).collect()}
    held = [i for i, _ in rows if crc(i) % 4 == 2]
    assert all(found[i].held_out == (crc(i) % 4 == 2) for i, _ in rows)
    assert sum(found[i].lang_pred == langs[i] for i in held) >= 0.95 * len(held) > 0


def test_language_edge_cases(spark, documents, odd):
    found = {(x.doc_id, x.lang_pred) for x in language_id.train_and_predict(documents(odd)).collect()}
    assert {(2, "und"), (3, "und"), (6, "und"), (8, "en"), (None, "en")} <= found
    nothing = documents(odd).withColumn("lang", F.lit(None).cast("string"))
    assert {(x.lang_pred, x.score) for x in language_id.train_and_predict(nothing).collect()} == {("und", 0.0)}
    assert language_id.train_and_predict(documents([])).count() == 0


def test_windows_cover_texts():
    import numpy as np

    data = np.arange(1, 601).astype(np.uint8)
    windows, owner, held = language_id.windows_of(data, np.array([0, 0, 256, 600]))
    assert owner.tolist() == [1, 2, 2] and held.tolist() == [256, 256, 88]
    assert np.concatenate([w[:h] for w, h in zip(windows, held, strict=True)]).tolist() == data.tolist()


def test_gradients_agree_with_differences():
    import numpy as np

    r = np.random.default_rng(3)
    network = language_id.Network(3)
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    windows, target = r.integers(1, 9, (4, 20)).astype(np.uint8), np.eye(3)[[0, 1, 2, 1]]

    def loss():
        return -np.log((network.probabilities(windows) * target).sum(axis=1)).mean()

    told = network.gradients(windows, target)
    for name, value in network.p.items():
        for at in list(zip(*np.nonzero(np.abs(told[name]) > 1e-4), strict=True))[:5]:
            before, ends = value[at], []
            for step in (1e-3, -1e-3):
                value[at] = before + step
                ends.append(loss())
            value[at] = before
            assert (ends[0] - ends[1]) / 2e-3 == pytest.approx(told[name][at], rel=0.05, abs=2e-3)


def conversations(n, seed=1):
    r, rows = random.Random(seed), []
    for c in range(n):
        for t in range(r.randint(2, 6)):
            role = "user" if t % 2 == 0 else "assistant"
            text = " ".join(["word"] * (r.randint(3, 9) if role == "user" else r.randint(60, 90)))
            rows.append((c, t, role, text[0].upper() + text[1:] + ("?" if role == "user" else ".\nMore of it.")))
    return rows


TURNS = "conv_id long, turn long, role string, text string"


def test_roles_of_held_out_transcripts(spark):
    found = chat_format.parse_conversations(spark.createDataFrame(conversations(150), TURNS)).collect()
    held = [x for x in found if x.held_out]
    assert sum(x.n_right for x in held) >= 0.97 * sum(x.n_told for x in held) > 0
    assert all(x.rendered.count("<|im_start|>") == x.n_turns == len(x.roles.split(",")) for x in found)


def test_chat_edge_cases(spark):
    rows = [(1, 0, None, "Hi"), (1, 0, None, "Hi"), (1, None, "user", None), (None, 1, "system", "Be <|kind|>."), (2, 300, "user", "late"), (2, 1, "assistant", "early"), (3, 0, "user", "x" * 200000)]
    found = {(x.conv_id, x.part): x for x in chat_format.parse_conversations(spark.createDataFrame(rows, TURNS)).collect()}
    assert set(found) == {(1, 0), (None, 0), (2, 2), (2, 0), (3, 0)} and found[(1, 0)].n_told == 2
    assert "< |kind|>" in found[(None, 0)].rendered
    assert chat_format.parse_conversations(spark.createDataFrame([], TURNS)).count() == 0
    model = chat_format.counts([])
    assert model.parse(None) == model.parse("") == (0, [])
    assert model.parse("User: a\nb\n\nAssistant: c")[1] == [("user", "a\nb"), ("assistant", "c")]


def test_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    model = chat_format.counts([("User: a b?\nmore\n\nBot: c.", [("user", "User: a b?\nmore"), ("assistant", "Bot: c.")])] * 3)
    seen = chat_format.observe(*chat_format.split_lines("Hello there\n\nBot: yes.\nand\nUser: why?"))

    def worth(path):
        emit = [sum(s[q, o[k]] for k, s in enumerate(model.seen)) for q, o in zip(path, seen, strict=True)]
        return model.start[path[0]] + sum(model.step[a, b] for a, b in itertools.pairwise(path)) + sum(emit)

    best = max(itertools.product(range(chat_format.STATES), repeat=len(seen)), key=worth)
    assert np.isclose(worth(best), worth(tuple(model.viterbi(seen))))


def test_repeated_and_null_ids_leave_room_for_texts(spark, documents, prose, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_PER_LANGUAGE", 5)
    seen = []
    monkeypatch.setattr(language_id.Network, "fit", lambda self, windows, classes: seen.append(len(windows)))
    ids = [i for i in range(40) if crc(i) % 4 != 2]
    rows = [(i, prose(10, i)) for i in ids for _ in range(10)] + [(None, prose(10, 99))] * 50
    language_id.train(documents(rows))
    assert seen == [5]


def test_every_language_is_trained_on(spark, documents, prose, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 2)
    monkeypatch.setattr(language_id, "MAX_PER_LANGUAGE", 6)
    monkeypatch.setattr(language_id.Network, "fit", lambda self, windows, classes: seen.append(len(windows)))
    seen, ids = [], [i for i in range(60) if crc(i) % 4 != 2]
    names, _ = language_id.train(documents([(i, prose(10, i)) for i in ids], {k: "abcd"[k % 4] for k in range(len(ids))}))
    assert names == ["a", "b", "c", "d"] and seen == [12]


def test_turns_are_kept_as_written():
    model = chat_format.counts([])
    text = "User: a  b\r\n\r\n\r\n  indented\r\n\r\nAssistant:  c \nAnswer: is in it\r\n\n[tool] {}\n"
    assert model.parse(text)[1][0] == ("user", "a  b\r\n\r\n\r\n  indented") and model.parse(text)[1][-1] == ("tool", "{}")
    assert chat_format.render([("user", " a\n\n\nb ")]) == "<|im_start|>user\n a\n\n\nb <|im_end|>\n"
    lines, gaps = chat_format.split_lines("a\r\rb\nc\r\nd\r\n\r\ne")
    assert lines == list("abcde") and gaps == [True, True, False, False, True]


def test_crowded_turns_are_dealt_out(spark):
    rows = [(1, 0, "user", f"t{k}") for k in range(1000)] + [(None, None, "user", f"n{k}") for k in range(900)] + [(2, 0, "tool", "x"), (2, 1, "odd", "y")]
    made = chat_format.transcripts(spark.createDataFrame(rows, TURNS)).collect()
    sizes = {(r.conv_id, r.part, r.slot): len(r.told) for r in made}
    assert sum(sizes.values()) == len(rows) and max(sizes.values()) < 2 * chat_format.PART and sizes[2, 0, 0] == 2
    assert [t.role for r in made if r.conv_id == 2 for t in r.told] == ["tool", "user"]


def test_clashing_columns_and_styles_held_out(spark):
    rows = [(*r, "x", "y", "z") for r in conversations(40)]
    table = spark.createDataFrame(rows, TURNS + ", told string, slot string, part string")
    made = chat_format.transcripts(table).withColumn("held", chat_format.held_out("conv_id")).collect()
    marks = {h: {r.text.split("ord")[0][:-1].strip() for r in made if r.held == h} for h in (True, False)}
    assert marks[True] & marks[False] <= {""} and chat_format.parse_conversations(table).count() == len(made)


def test_features_of_a_text_are_bounded(monkeypatch):
    import numpy as np

    monkeypatch.setattr(toxicity, "MAX_FEATURES", 10)
    ids, counts = np.arange(100, dtype=np.int32), np.arange(100).astype(np.uint16)
    a, b = toxicity._bounded(ids, counts)
    assert len(a) == 10 and (a == b).all() and (np.diff(a) > 0).all()
    c, _ = toxicity._bounded(ids[a.min() :], counts[a.min() :])
    assert set(a) <= set(c)  # by hash, whatever else a text holds


def test_toxicity_scores_equal_plain_sums(spark, documents, prose, odd):
    """The scores of the query's own table, from features counted one by one."""
    import math

    import numpy as np

    rows = [(i, prose(30, i) + (" vile nasty" if i % 3 == 0 else "")) for i in range(120)] + odd
    table, bias = toxicity.train(documents(rows), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int"))
    told = sorted((r.doc_id or -1, r.score) for r in toxicity.score(documents(rows), table, bias).collect())
    plain = []
    for i, t in rows:
        data = np.frombuffer((t or "").encode(), np.uint8)
        total, weight = 0.0, 0.0
        for buckets, _ in toxicity.features(data, np.array([0, len(data)])):
            for b in buckets.tolist():
                total, weight = total + float(table[b, 0]), weight + float(table[b, 1])
        plain.append((i or -1, 1 / (1 + math.exp(-(total / max(weight, 1) + bias)))))
    assert [x[0] for x in told] == [x[0] for x in sorted(plain)]
    assert [x[1] for x in told] == pytest.approx([x[1] for x in sorted(plain)], rel=1e-6)


def test_language_scores_equal_plain_convolutions():
    import numpy as np
    import pyarrow as pa

    network, text = language_id.Network(3), "abc é def " * 40
    p, sums = network.p, np.zeros(3)
    raw = text.encode()
    for at in range(0, len(raw), language_id.WINDOW):
        window = raw[at : at + language_id.WINDOW]
        padded = np.frombuffer(window.ljust(language_id.WINDOW + 3, b"\0"), np.uint8)
        best = np.full(p["filters"].shape[1], -np.inf)
        for k in range(language_id.WINDOW):
            best = np.maximum(best, p["embed"][padded[k : k + 4]].reshape(-1) @ p["filters"])
        logit = np.maximum(best + p["shift"], 0) @ p["out"] + p["bias"]
        e = np.exp(logit - logit.max())
        sums += e / e.sum() * len(window)
    assert language_id.mean_probabilities(pa.array([text]), network)[0] == pytest.approx(sums / len(raw), rel=1e-4)
