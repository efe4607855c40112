"""Surrogates of names, e-mails and addresses: distinct, in the form of the original, none of it left."""

import re

import regex

from annotlake.llm import pii

NAME = regex.compile(pii._NAME)


def test_five_thousand_names(spark):
    """Brute check of distinctness, script, ending and pattern."""
    sounds = ["ba", "de", "ki", "lo", "mu", "na", "re", "si", "to", "vu"]
    latin = ["".join(sounds[int(c)] for c in f"{k:04d}").capitalize() for k in range(2400)]
    letters = ["ба", "де", "ки", "ло", "му", "на", "ре", "си", "то", "ву"]
    cyrillic = ["".join(letters[int(c)] for c in f"{k:04d}").capitalize() + ("ова" if k % 2 else "ов") for k in range(2400)]
    forms = [("name", f"Anna {x}" if k % 2 else x, "f" if k % 2 else "u") for k, x in enumerate(latin)]
    forms += [("name", f"Иван {x}" if k % 2 == 0 else x, "m" if k % 2 == 0 else "u") for k, x in enumerate(cyrillic)]
    forms += [("name", f"{first} Adams", "u") for first in latin[:200]]
    rows = pii.surrogates(spark.createDataFrame(forms, "kind string, form string, gender string"), "k").collect()
    assert len(rows) == 5000 == len({r["core"] for r in rows})
    assert not {r["core"] for r in rows} & {x[1] for x in forms}
    family = {}
    for r in rows:
        old, new = r["form"].split(" "), r["core"].split(" ")
        assert len(old) == len(new) and all(NAME.fullmatch(x) for x in new) and not set(old) & set(new)
        assert all(bool(re.search("[а-яё]", a)) == bool(re.search("[а-яё]", b)) and bool(re.search("[a-z]", a)) == bool(re.search("[a-z]", b)) for a, b in zip(old, new))
        if old[-1].endswith(("ова", "ов")):
            assert new[-1].endswith(("ова", "ева", "ина")) if old[-1].endswith("ова") else new[-1].endswith(("ов", "ев", "ин"))
        assert family.setdefault(old[-1], new[-1]) == new[-1]


def test_emails_and_addresses_keep_their_shape(spark):
    mails = [f"{c}{d}@b.com" for c in "abcdefghij" for d in range(10)] + ["anna.smith-2@corp.net", "иван@почта.рф"]
    forms = [("email", m, "u") for m in mails] + [("ip6", f"2001:db8::{k:x}", "u") for k in range(300)] + [("ip6", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "u")]
    rows = pii.surrogates(spark.createDataFrame(forms, "kind string, form string, gender string"), "k").collect()
    assert len({(r["kind"], r["core"]) for r in rows}) == len(forms)
    got = {r["form"]: r["core"] for r in rows}
    assert re.fullmatch(r"[a-z]{4}\.[a-z]{5}-\d@[a-z]+\.example\.net", got["anna.smith-2@corp.net"])
    assert re.fullmatch(r"[а-я]{4}@[a-z]+\.example\.org", got["иван@почта.рф"])
    assert len({got[m].split("@")[1] for m in mails[:100]}) == 1 and all(re.fullmatch(r"[a-z]\d[a-z]*", got[m].split("@")[0]) for m in mails[:100])
    assert re.fullmatch(r"fd[0-9a-f]{2}(:[0-9a-f]{4}){7}", got["2001:0db8:85a3:0000:0000:8a2e:0370:7334"])
    for r in rows:
        assert regex.fullmatch(pii.PATTERNS[r["kind"]], r["core"]), r


def test_untitled_names_and_first_names(spark):
    texts = [
        "Mrs Anna Baker sat.", "Ms Anna Cole sat.", "Miss Anna Dunn sat.", "Mr Paul Smith sat.", "Mr Karl Smith sat.", "Mr Smith sat.",
        "Yesterday Anna Smith came, and Anna laughed at Smith's hat. Call John Smith now.",
        "Mr Sean O'Brien and Frau Eva Meyer-Lang. Sean left, Brien stayed.",
        "From 2001:db8::1 at 12:30:45, std::vector and dead::beef stay.",
        "Annabel Smithers and New York stay.",
        "x " * 300_000 + "Anna Smith",
    ]
    docs = spark.createDataFrame([*enumerate(texts), (6, texts[6])], "doc_id long, text string")
    rows = pii.replace_entities(docs, count="n").collect()
    out = {r["doc_id"]: r for r in rows}
    m = re.fullmatch(r"Yesterday (\w+) (\w+) came, and (\w+) laughed at (\w+)'s hat\. Call John (\w+) now\.", out[6]["text"])
    assert m and m[1] == m[3] not in ("Anna", "John") and m[2] == m[4] == m[5] != "Smith" and m[1] in pii.FEMALE and out[6]["n"] == 4
    assert out[3]["text"].split()[2] == m[2] and [r["text"] for r in rows].count(out[6]["text"]) == 2
    m = re.fullmatch(r"Mr (\w+) (O'\p{Lu}\w+) and Frau (\w+) (\w+-\w+)\. (\w+) left, Brien stayed\.".replace(r"\p{Lu}", "[A-Z]"), out[7]["text"])
    assert m and m[1] == m[5] != "Sean" and m[2] != "O'Brien" and m[3] in pii.FEMALE and m[3] != "Eva"
    assert re.fullmatch(r"From fd[0-9a-f]{2}:[0-9a-f]{3}::[0-9a-f] at 12:30:45, std::vector and dead::beef stay\.", out[8]["text"])
    assert out[9]["text"] == texts[9] and out[10]["text"].endswith(f"{out[6]['text'].split()[1]} {out[6]['text'].split()[2]}")
    strict = {r["doc_id"]: r["text"] for r in pii.replace_entities(docs, evidence=4).collect()}
    assert strict[6] == texts[6]
