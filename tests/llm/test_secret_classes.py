"""Bare random strings of each alphabet are found by entropy."""

import random
import string

ALPHABETS = {
    "base32": string.ascii_uppercase + "234567",
    "upper": string.ascii_uppercase + string.digits,
    "lower": string.ascii_lowercase + string.digits,
    "mixed": string.ascii_letters + string.digits,
}


def test_random_strings_of_each_class(spark):
    from lodestone.llm.secrets import scan

    draw = random.Random(9)
    rows = []
    for name, letters in ALPHABETS.items():
        for size in (20, 32, 40):
            for _ in range(100):
                run = draw.choices(letters, k=size)
                run[draw.randrange(size)] = draw.choice("234567")  # a run of letters alone is read as a word
                rows.append((name, "key " + "".join(run) + " end"))
    rows += [("", "Internationalisierungsstrategien und donaudampfschifffahrtsgesellschaft"), ("", "AAAAAAAAAAAAAAAAAAAA0000000000")]
    found = scan(spark.createDataFrame(rows, "name string, text string")).collect()
    for name in ALPHABETS:
        of = [r for r in found if r["name"] == name]
        missed = [r["text"] for r in of if not any((s["start"], s["end"]) == (4, len(r["text"]) - 4) for s in r["found"])]
        assert len(missed) <= 0.03 * len(of), (name, len(missed))
    assert not any(r["found"] for r in found if not r["name"])
