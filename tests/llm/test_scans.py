import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from forumlens.llm import chat, classifier, decontaminate, secret_scan
from forumlens.sources.fixtures import table
from tests.conftest import SMALL
from tests.llm.helpers import frame, odd_rows, prose, texts

ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def base_spans(text):
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(ASSIGN, text, re.I | re.A) if len(m[2]) >= 8]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


SECRETS = [
    (40, "é Password = 'abcdefgh1' token=short api_key:\"A+/=_.-zz\" TOKEN=PASSWD:abcdefghi"), (41, "AKIA" + "Z9" * 6 + " AKIAshort AKIAAKIA" + "A" * 9),
    (42, "x" + "0a" * 16 + "g " + "f" * 31 + " " + "0" * 500), (43, "ſecret=abcdefgh1 toKen=abcdefgh1 apikey: " + "e" * 40),
    (44, "-----BEGIN RSA PRIVATE KEY-----"),
]


def test_base_rules_and_paths(spark):
    rows = odd_rows() + SECRETS + [(50, SECRETS[0][1])]
    got = secret_scan.scan(frame(spark, rows)).collect()
    spans = lambda r: tuple((s["first"], s["rank"], s["kind"], s["end"]) for s in r["spans"] if s["rank"] < 3)
    assert Counter((r["doc_id"], spans(r)) for r in got) == Counter((i, tuple(base_spans(t))) for i, t in texts(rows))
    assert [s["kind"] for r in got if r["doc_id"] == 44 for s in r["spans"]] == ["key_block"]


def test_long_logins_in_addresses(spark):
    token = "github_" + "pat_" + "A1" * 41
    rows = [(1, f"git clone https://me:{token}@host.example/x"), (2, f"ftp://{'u' * 500}:{'p' * 5000}@h"), (3, "http://host:80/a@b " + "://" * 5000)]
    got = {r["doc_id"]: [(s["kind"], s["first"], s["end"]) for s in r["spans"]] for r in secret_scan.scan(frame(spark, rows)).collect()}
    assert len(token) == 93 and got == {1: [("url_login", 10, 10 + 12 + 93)], 2: [("url_login", 0, 6 + 500 + 1 + 5000 + 1)], 3: []}


def test_only_unseen_pairs_are_scanned(spark, tmp_path):
    ledger = f"file://{tmp_path}/ledger"
    rows = odd_rows() + SECRETS
    assert secret_scan.scan(frame(spark, rows), ledger).count() == len(rows)
    before = secret_scan.read_ledger(spark, ledger).select("blob").distinct().count()
    assert before == len({t for _, t in texts(rows)})
    n = secret_scan.read_ledger(spark, ledger).count()
    again = secret_scan.scan(frame(spark, [*rows, (60, "new"), (61, "new")]), ledger)
    assert again.count() == len(rows) + 2 and secret_scan.read_ledger(spark, ledger).count() == n + 1
    secret_scan.scan(frame(spark, [(60, "new")]), ledger, version="rules-2")
    assert secret_scan.read_ledger(spark, ledger).where("rule_version = 'rules-2'").count() == 1
    assert secret_scan.scan(frame(spark, rows).where("false")).count() == 0


def brute_hits(text, items, window):
    hit, found = set(), set()
    for number, item in items:
        n = min(window, len(item))
        for k in range(len(item) - n + 1 if n else 0):
            for at in range(len(text) - n + 1):
                if text[at:at + n] == item[k:k + n]:
                    hit.update(range(at, at + n))
                    found.add(number)
    return hit, found


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=9), max_size=5), st.lists(st.sampled_from([b"a", b"b", b"c", b"z"]), max_size=25))
def test_automaton_against_all_windows(items, text):
    items = list(enumerate(items))
    spans, found = decontaminate.Automaton(items, 4).find(text)
    assert ({p for a, b, _ in spans for p in range(a, b)}, found) == brute_hits(text, items, 4)
    for a, b, longest in spans:
        assert longest == max(n for n in range(1, len(text) + 1) for _, item in items for k in range(len(item) - n + 1)
                              if any(text[e - n:e] == item[k:k + n] for e in range(a + 1, b + 1) if e >= n))


def decontamination_tables(spark):
    items = [(1, prose(40, 5)), (2, "Short ITEM here"), (3, None), (4, ""), (1, prose(40, 5)), (None, prose(30, 4000)), (5, prose(20, 300))]
    docs = odd_rows() + [(70, "x. " + prose(40, 5).title() + " y"), (71, "a short item, here and " + prose(200, 7000)),
                         (72, prose(300, 9000) + " " + prose(13, 305)), (73, prose(12, 5)), (74, prose(15, 4003))]
    return docs, frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), items


@pytest.mark.parametrize("shard_chars", [1 << 24, 100])
def test_decontamination(spark, shard_chars):
    rows, docs, benchmark, items = decontamination_tables(spark)
    coded = [(i, decontaminate.words((t or "").encode())) for i, t in items]
    got = Counter((r["doc_id"], r["n_words"], sum(s["end"] - s["first"] for s in r["spans"]), tuple(r["items"]))
                  for r in decontaminate.find(docs, benchmark, shard_chars=shard_chars).collect())
    expected = Counter()
    for i, t in texts(rows):
        text = decontaminate.words(t.encode())
        hit, found = brute_hits(text, coded, 13)
        expected[i, len(text), len(hit), tuple(sorted(found - {None}))] += 1
    assert got == expected


def test_cleaning(spark):
    rows, docs, benchmark, _ = decontamination_tables(spark)
    cleaned = decontaminate.clean(docs, benchmark)
    assert cleaned.schema.names == docs.schema.names
    got = {r["doc_id"]: r for r in cleaned.collect()}
    assert 70 not in got and 74 not in got and got[71]["text"] == "a  and " + prose(200, 7000)
    assert got[72]["text"] == prose(300, 9000) + " " and got[72]["n_chars"] == len(got[72]["text"]) and got[73]["text"] == prose(12, 5)
    assert got[3]["text"] is None and got[3]["n_chars"] == -1 and got[71]["tie"] == "tie"
    assert decontaminate.clean(docs, benchmark.where("false")).count() == len(rows)
    assert decontaminate.clean(docs.where("false"), benchmark).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("a\n\\<|>im_startend ", max_size=25), st.text("a\n\\<|>im_startend ", max_size=40)), max_size=5))
def test_markup_is_reversible(turns):
    formatted = chat.chat_markup(turns)
    assert chat.parse(formatted) == turns and formatted.count("<|") == 2 * len(turns)
    text, spans, starts, rewritten = chat.render_block(chat.chat_markup, [], turns, frozenset(["a"]))
    assert text == formatted and not rewritten and len(starts) == len(turns)
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for role, t in turns if role == "a"]


def conversation_rows():
    rows = [(1, k, ("user", "assistant")[k % 2], f"turn {k} <|im_end|>\n") for k in range(2 * chat.BLOCK_TURNS + 5)]
    return rows + [(2, 0, "user", None), (2, 0, "assistant", "tie"), (2, None, None, "first"), (2, 1, "assistant", "x"),
                   (2, 1, "assistant", "x"), (None, 0, "assistant", "nobody's")]


def test_conversations_are_read_back(spark):
    rows = conversation_rows()
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, block string")
    blocks = chat.format_conversations(df)
    assert blocks.where("conv_id = 1").count() == 3
    got = {r["conv_id"]: r for r in chat.read_back(blocks).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")
    for number in (1, 2, None):
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == number), key=key)]
        said = "".join(t for role, t in turns if role == "assistant")
        r = got[number]
        assert (r["n_turns"], r["loss_chars"], r["rewritten"]) == (len(turns), len(said), False)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert r["formatted_chars"] == len(chat.chat_markup(turns))
    assert chat.read_back(chat.format_conversations(df.where("false"))).count() == 0


def test_rewritten_history_is_detected(spark):
    def forgetful(turns):
        """Drops the text of all but the last turn, as templates do with earlier reasoning."""
        return "".join(f"[{role}]{text if k == len(turns) - 1 else ''}" for k, (role, text) in enumerate(turns))

    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "alone")],
                               "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.format_conversations(df, forgetful).collect()}
    assert got[1]["rewritten"] and got[1]["mask"] == [] and not got[2]["rewritten"]


def test_blocks_know_the_conversation(spark):
    n = 2 * chat.BLOCK_TURNS + 5
    far = chat.BLOCK_TURNS + 9

    def strict(turns):
        """Reads the system turn, and wants users and assistants by turns."""
        assert turns[0][0] == "system" and all(role == ("user", "assistant")[k % 2] for k, (role, _) in enumerate(turns[1:]))
        return "".join(f"[{turns[0][1]}|{role}]{text}" for role, text in turns)

    def forgetful(turns):
        """Drops one turn's text when the next one comes."""
        return "".join(f"[{role}]{'' if text == 'forget' and k < len(turns) - 1 else text}" for k, (role, text) in enumerate(turns))

    def numbered(turns):
        return "".join(f"[{k} {role}]{text}" for k, (role, text) in enumerate(turns))

    def late(turns):
        """Drops the first turn when the conversation is long."""
        return "".join(f"[{role}]{text}" for role, text in turns[len(turns) > chat.BLOCK_TURNS + 20:])

    rows = [(1, 0, "system", "S")] + [(1, k, ("assistant", "user")[k % 2], f"t{k}") for k in range(1, n)]
    rows += [(2, k, ("user", "assistant")[k % 2], "forget" if k == far else f"t{k}") for k in range(n)]
    rows += [(None, k, ("user", "assistant")[k % 2], "forget" if k == far else f"t{k}") for k in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = [(role, text) for c, _, role, text in rows if c == 1]

    def formatted(template, part="conv_id = 1", **more):
        return chat.format_conversations(df.where(part), template, **more).orderBy("conv_id", "block").collect()

    blocks = formatted(strict)
    assert "".join(r["text"] for r in blocks) == strict(turns) and not any(r["rewritten"] for r in blocks)
    assert sum(len(r["mask"]) for r in blocks) == sum(role == "assistant" for role, _ in turns)
    found = formatted(forgetful, "true")
    assert len(found) == 9 and all(r["rewritten"] == (r["conv_id"] != 1) == (r["mask"] == []) for r in found)
    assert "".join(r["text"] for r in formatted(numbered, context_turns=None)) == numbered(turns)
    assert all(r["rewritten"] and r["mask"] == [] for r in formatted(late, context_turns=None))


def test_classifier_on_held_out_rows(spark):
    docs, labels = table(spark, SMALL.replace("0.001", "0.01"), "documents"), table(spark, SMALL.replace("0.001", "0.01"), "labels")
    model = classifier.fit(docs, labels)
    scored = classifier.score(docs, model).withColumn("held", classifier.held_out(F.col("doc_id")))
    rows = scored.where("held").join(labels, "doc_id").collect()
    right = {q: np.mean([r["predicted"] == q for r in rows if r["quality"] == q]) for q in (0, 1)}
    assert len(rows) > 80 and right[0] > 0.9 and right[1] > 0.95


def test_classifier_on_odd_tables(spark):
    docs = frame(spark, odd_rows())
    labels = spark.createDataFrame([(k, None if k == 2 else k % 2, k) for k in range(10)] + [(None, 1, 1)], "doc_id long, quality int, tie int")
    got = classifier.score(docs, classifier.fit(docs, labels)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in odd_rows())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    nothing = classifier.fit(docs, labels.where("false"))
    assert {r["score"] for r in classifier.score(docs, nothing).collect()} == {0.5}
    assert classifier.score(docs.where("false"), nothing).count() == 0
