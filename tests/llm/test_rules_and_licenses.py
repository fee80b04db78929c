import re
import textwrap
from collections import Counter

from forumlens.llm import licenses, rules
from tests.llm.helpers import CLASHES, frame, odd_rows, prose, texts

SPACE = " \t\n\x0b\x0c\r"


def measure(text):
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", text) if w]
    windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    many = Counter(windows)
    inside = {k + j for k, w in enumerate(windows) if many[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines),
            len(lines) - len(set(lines)), len(inside))


def judged(spark, rows):
    return rules.ledger(frame(spark, rows)).collect()


def test_measurements(spark):
    rows = odd_rows() + [(20, "a b c a b c a b"), (21, "a a a a"), (22, "a b c x a b c y"), (23, "a b\na b\n\n a b"), (24, "#a$ |b| <c> %d&")]
    got = Counter((r["doc_id"], *(r[m] for m in rules.MEASURES[:6])) for r in judged(spark, rows))
    assert got == Counter((i, *measure(t)) for i, t in texts(rows))


def test_bits_policies_and_ablations(spark):
    rows = [(1, prose(60)), (2, "few words"), (3, " ".join(["again and again"] * 40)), (4, prose(60).replace(" ", "$$ ")),
            (5, prose(60).upper()), (6, None)]
    entries = rules.ledger(frame(spark, rows))
    bits = {r["doc_id"]: r["fail_bits"] for r in entries.collect()}
    failed = {i: {name for k, name in enumerate(rules.RULES) if b >> k & 1} for i, b in bits.items()}
    assert failed[1] == set() and failed[2] == {"too_few_words"} and "repeated_words" in failed[3]
    assert failed[4] == {"many_symbols"} and failed[5] == {"shouting"} and "too_few_words" in failed[6]
    kept = {r["doc_id"]: r["kept"] for r in rules.apply_policy(entries, rules.BASE).collect()}
    assert kept == {1: True, 2: False, 3: False, 4: True, 5: True, 6: False}
    found = {(r["policy"], r["without"]): (r["n_docs"], r["n_kept"]) for r in rules.ablations(entries, rules.BASE, rules.STANDARD).collect()}
    for policy in (rules.BASE, rules.STANDARD):
        for without in (None, *policy.rules):
            left = set(policy.rules) - {without}
            assert found[policy.name, without] == (6, sum(not failed[i] & left for i in failed))


def test_filtering_keeps_columns(spark):
    rows = odd_rows()
    df = frame(spark, rows)
    kept = rules.filter_documents(df)
    assert kept.schema == df.schema
    good = Counter((r["doc_id"]) for r in judged(spark, rows) if r["fail_bits"] == 0)
    assert Counter(r["doc_id"] for r in kept.collect()) == good and good[1] == 2
    assert all(tuple(r[c] for c in CLASHES) == CLASHES for r in kept.collect())
    assert rules.filter_documents(df.where("false")).count() == 0


def brute_findings(text):
    low = text.lower()
    parts = [re.sub(r"[^\w]|_", " ", u).split() for u in re.split(r"(?<=[.!?])[ \t\r]+|\n", low)]
    parts += [re.sub(r"[^\w]|_", " ", u).split() for u in low.split("\n")] + [re.sub(r"[^\w]|_", " ", low).split()]
    out = set()
    for words in {tuple(p) for p in parts}:
        pairs = Counter(zip(words, words[1:]))
        best = []
        for name, wording in licenses.TEMPLATES.items():
            own = re.findall(r"[a-z0-9]+", wording.lower())
            bag = Counter(zip(own, own[1:]))
            dice = 2 * (pairs & bag).total() / (pairs.total() + bag.total())
            if dice >= licenses.THRESHOLD:
                best.append((-dice, name))
        if best:
            out.add((*min(best), " ".join(words)))
    return out


def test_licences(spark):
    mit, gpl = licenses.TEMPLATES["mit-permission"], licenses.TEMPLATES["gpl-3.0-notice"]
    rows = odd_rows() + [
        (30, "Prose. Released under the MIT License. More prose."), (31, prose(90) + "\n# " + gpl.replace(" ", "\n# ", 1)),
        (32, mit), (33, mit.replace("free of charge", "at no cost")), (34, "CC BY-NC 4.0"), (35, "the MIT License"),
        (36, licenses.TEMPLATES["gpl-2.0-notice"] + "\n" + prose(40)), (37, "Licensed under the Apache License, Version 2.0. Thwhing on.")]
    got = [(r["doc_id"], {(-f["dice"], f["name"], f["unit"]) for f in r["findings"]})
           for r in licenses.scan(frame(spark, rows)).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, sorted(x[1]))
    assert sorted(got, key=key) == sorted(((i, brute_findings(t)) for i, t in texts(rows)), key=key)
    found = dict(got)
    assert all(found[i] for i in (30, 32, 33, 34, 36, 37)) and not found[8]
    assert licenses.scan(frame(spark, rows).where("false")).count() == 0


def test_notices_inside_other_text(spark):
    long = [n for n, w in licenses.TEMPLATES.items() if len(w) > 140]
    wrapped = {n: prose(30) + "\n" + textwrap.fill(licenses.TEMPLATES[n], 72) + "\n" + prose(30, 300) for n in long}
    inside = {n: prose(30) + ", " + licenses.TEMPLATES[n] + " " + prose(30, 300) for n in licenses.TEMPLATES}
    rows = [("w", n, t) for n, t in wrapped.items()] + [("i", n, t) for n, t in inside.items()]
    rows += [("c", "mit-permission", wrapped["mit-permission"].replace("free of charge", "at no cost")),
             ("s", "mit-line", "This project is released under the MIT License, like the other ones that we have made so far."),
             ("2", "apache-2.0-notice,mit-permission", wrapped["apache-2.0-notice"] + "\n" + wrapped["mit-permission"]),
             ("n", "", prose(40) + " the software is provided under a license of the public, subject to conditions " + prose(9))]
    got = {r["doc_id"]: r["findings"] for r in licenses.scan(frame(spark, list(enumerate(t for *_, t in rows)))).collect()}
    for i, (kind, names, _) in enumerate(rows):
        found = {f["name"] for f in got[i]} - ({"apache-2.0-line"} if "apache" in names else set())  # a line of the notice may be a unit
        assert found == set(names.split(",")) - {""} or names == "apache-2.0-line" and not found, (kind, names, got[i])
        assert kind in "cn" or max(f["dice"] for f in got[i]) == 1.0
    assert licenses.scan(frame(spark, [(1, "license"), (2, "License\n\n")])).where("size(findings) > 0").count() == 0


def test_every_match_has_a_cue():
    words = licenses.cues(licenses.TEMPLATES, licenses.THRESHOLD)
    for wording in licenses.TEMPLATES.values():
        pairs = licenses.bigrams(wording)
        without = [p for p in pairs if not set(p.split()[:2]) & set(words)]
        assert len(without) < len(pairs) * licenses.THRESHOLD / (2 - licenses.THRESHOLD)
