"""Deobfuscation against all paths and planted disguises; scores by held-out accuracy."""

import itertools
import random
import zlib

import duckdb
import numpy as np
import pytest

from taxloom.llm import queries, toxicity
from tests.llm import plain


def model_of(text):
    return toxicity.smoothed(toxicity.text_trigrams([text]).reshape((toxicity.SYMBOLS,) * 3).astype(float))


COSTS = model_of("you are an idiot and a moron , the loser is a clown . what a stupid thing to say in the end of the day , trash and scum and pathetic people " * 40)


def path_cost(chars):
    a = b = 0
    total = 0.0
    for c in [*chars, " "]:
        s = toxicity._symbol(c)
        if s or b:
            total, a, b = total + float(COSTS[a, b, s]), b, s
    return total


@pytest.mark.parametrize("token", ["id10t", "m0-r0n", "loooser", "c1.0wn", "a+b", "x!!y", "i d i o t", "é5é", "$cum", "st00pid"])
def test_decoding_takes_the_cheapest_of_all_paths(token):
    paths = itertools.product(*toxicity.lattice(token))
    least = min(sum(c for _, c in p) + path_cost("".join(m for m, _ in p)) for p in paths)
    words = " ".join(toxicity.decode(token, COSTS))
    reached = [sum(c for _, c in p) + path_cost("".join(m for m, _ in p)) for p in itertools.product(*toxicity.lattice(token))
               if "".join(m for m, _ in p).split() == words.split()]
    assert min(reached) == pytest.approx(least, abs=1e-4)


@pytest.mark.parametrize("seen,meant", [("id10t", "idiot"), ("1d1ot!!!", "idiot"), ("m0r0n,", "moron"), ("looooser", "loser"), ("c|own", "clown"), ("l.o.s.e.r", "loser"),
                                        ("s-t-u-p-i-d", "stupid"), ("p@thet1c", "pathetic"), ("tr4$h", "trash"), ("t r a s h", "trash"), ("5cum", "scum"), ("idi*ot", "idiot")])
def test_disguised_words_are_restored(seen, meant):
    assert meant + "$" in toxicity.Reader(COSTS).read(f"the {seen} of")[0]


@pytest.mark.parametrize("token,words", [("the", ["the"]), ("day.", ["day"]), ("2024", []), ("", []), ("of$$$", ["of"]), ("THE!!".lower(), ["the"]), ("$$$", []), ("日本語", ["日本語"])])
def test_plain_tokens_stay(token, words):
    assert toxicity.words_of(token, COSTS) == words


def plain_trigrams(text):
    s = [0]
    for c in text:
        if toxicity._symbol(c) or s[-1]:
            s.append(toxicity._symbol(c))
    s += [0] if s[-1] else []
    return [tuple(s[i:i + 3]) for i in range(len(s) - 2)]


@pytest.mark.parametrize("size", [1, 3, 50, 1 << 20])
def test_trigram_counts_are_those_of_whole_texts(size, monkeypatch):
    monkeypatch.setattr(toxicity, "SLICE", size)
    texts = [r[1][:3000] for r in plain.odd_documents(groups=1) if r[1]] + ["Ä ß  x", "日本 a", "  -- ", "a", "end  ", "  ab\n\n c"]
    expected = np.zeros((toxicity.SYMBOLS,) * 3)
    for text in texts:
        for t in plain_trigrams(text):
            expected[t] += 1
    assert (toxicity.text_trigrams(texts) == expected.reshape(-1)).all()


def planted(seed, n):
    rng = random.Random(seed)
    bad, rows, labels = ["gronk", "blarf", "zwickel"], [], []
    disguise = {"o": "0", "a": "4", "i": "1", "e": "3"}
    for i in range(n):
        toxic = rng.random() < 0.3
        words = plain.prose(rng, rng.randint(20, 200)).split(" ")
        for _ in range(3 if toxic else 0):
            word = rng.choice(bad)
            hidden = rng.choice([word, word.upper(), "".join(disguise.get(c, c) for c in word), ".".join(word), " ".join(word)])
            words.insert(rng.randrange(len(words)), hidden)
        rows.append((i, " ".join(words), "en", f"s{i % 3}", i))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_planted_words_are_found_in_rows_held_out(spark):
    rows, labels = planted(1, 500)
    odd = [(None, "text", "en", "s", 1), (9000, None, "en", "s", 1), (9001, "", None, None, None), (3, rows[3][1], "en", "s", 1), (9002, "x" * 100_000, "en", "s", 1)]
    df = spark.createDataFrame([(*r, 0.5, True) for r in rows + odd], plain.DOCUMENTS + ", score double, held_out boolean")
    told = spark.createDataFrame(labels + [(None, 1, 1), (5, 1, None), (77777, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = toxicity.score_toxicity(df, told).collect()
    assert len(got) == len(rows) + len(odd)
    truth = {d: t for d, _, t in labels}
    tested = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got) and len(tested) > 70
    wrong = [r["doc_id"] for r in tested if r["doc_id"] in truth and truth[r["doc_id"]] != r["predicted"]]
    assert len(wrong) <= 2
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert not any(r["predicted"] for r in got if r["doc_id"] in (9000, 9001, 9002))


def test_without_labels_or_documents(spark):
    rows, labels = planted(2, 20)
    df = spark.createDataFrame(rows, plain.DOCUMENTS)
    told = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    assert {round(r["score"], 6) for r in toxicity.score_toxicity(df, told.limit(0)).collect()} == {0.0}
    assert {r["predicted"] for r in toxicity.score_toxicity(df, told.withColumn("toxic", told.quality)).collect()} == {1}
    assert toxicity.score_toxicity(df.limit(0), told).count() == 0


def test_query_on_held_out_rows(spark, sf):
    larger = sf.replace("0.001", "0.01")
    got = queries.QUERIES["op12_toxicity"](spark, larger).collect()
    truth = dict(duckdb.sql(f"select doc_id, toxic from '{larger}/labels.parquet' where toxic is not null").fetchall())
    tested = [(truth[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in truth]
    toxic = [p for t, p in tested if t]
    assert sum(toxic) >= 0.6 * len(toxic) and sum(p for t, p in tested if not t) <= 0.02 * len(tested)
