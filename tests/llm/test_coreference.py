"""Later mentions of a text's entities."""

import re

from annotlake.llm import pii


def test_names_and_numbers_in_other_forms(spark):
    texts = [
        "Mrs Anna Smith came. Mrs Smith left; later Anna Smith and Smith's son (not Smithson) called (310) 555-4510, 310 555 4510 or 13105554510.",
        "Mr John Smith met Frau Weber. Weber saw Smith.",
        "Smith and Anna Smith alone stay, 310 555 4510 too.",
        "Г-жа Анна Иванова. Иванова ушла.",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r for r in pii.replace_entities(docs, count="n").collect()}
    new = [out[k]["text"] for k in range(len(texts))]
    m = re.fullmatch(r"Mrs (\w+) (\w+) came\. Mrs (\w+) left; later (\w+) (\w+) and (\w+)'s son \(not Smithson\) called \((\d{3})\) (\d{3})-(\d{4}), (\d{3}) (\d{3}) (\d{4}) or 1(\d{10})\.", new[0])
    first, family = m[1], m[2]
    assert family != "Smith" and (m[3], m[4], m[5], m[6]) == (family, first, family, family)
    assert m.groups()[6:9] == m.groups()[9:12] and m[13] == "".join(m.groups()[6:9]) != "3105554510"
    m = re.fullmatch(r"Mr (\w+) (\w+) met Frau (\w+)\. (\w+) saw (\w+)\.", new[1])
    assert m[2] == m[5] == family and m[3] == m[4] != family
    assert new[2] == texts[2]
    m = re.fullmatch(r"Г-жа (\w+) (\w+)\. (\w+) ушла\.", new[3])
    assert m[2] == m[3] != "Иванова"
    assert [out[k]["n"] for k in range(4)] == [7, 4, 0, 2]
