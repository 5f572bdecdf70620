"""One surname and one phone number get one surrogate in all their spellings."""

import re

from listingflow.llm import pii

ROWS = [
    (1, "Mr. Kowalski"),
    (2, "Mr Kowalski"),
    (3, "Mr. Jan Kowalski"),
    (4, "Mrs. Anna Kowalski"),
    (5, "Mr. Jan F. KOWALSKI"),
    (6, "Mr. Jan Nowak"),
    (7, "Mr. Kowalski's"),
    (8, "Mrs. Jan Nowak"),
    (9, "Κύριος Νίκος Παπάς"),
    (10, "+1 (377) 555-0271"),
    (11, "377-555-0271"),
    (12, "+13775550271"),
    (13, "(377) 555-0271"),
    (14, "+48 512 345 678"),
    (15, "+48512345678"),
    (16, "512-345-678"),
    (17, "+44 20 7946 0958"),
    (18, "+442079460958"),
    (19, "Mr. John Fitzgerald Kennedy"),
]


def test_spellings_share_their_surrogate(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    out = {r["doc_id"]: r for r in pii.replaced(docs, key="k").collect()}
    got = {i: r["text"] for i, r in out.items()}
    assert all(r["n_entities"] == 1 and r["surrogates"] == [r["text"]] for r in out.values())
    old = dict(ROWS)
    assert all(len(got[i].split()) == len(old[i].split()) and got[i].split()[0] == old[i].split()[0] for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 19))
    last = {i: got[i].split()[-1] for i in range(1, 10)}
    assert last[1] == last[2] == last[3] == last[4] and last[5] == last[1].upper() and last[7] == last[1] + "'s"
    assert last[6] == last[8] != last[1] and last[1].lower() != "kowalski"
    first = {i: got[i].split()[1] for i in (3, 5, 6, 8)}
    assert first[3] == first[5] == first[6] and first[3].endswith("an") and first[8] == first[3][:-2] + "ina"
    assert re.fullmatch(r"[A-Z]\.", got[5].split()[2]) and re.fullmatch("Κύριος [Α-Ω]\\w+ος [Α-Ω]\\w+", got[9])
    digits = {i: re.sub("[^0-9]", "", got[i]) for i in range(10, 19)}
    assert digits[10] == digits[12] == "1" + digits[11] and digits[11] == digits[13] != "3775550271"
    assert digits[14] == digits[15] == "48" + digits[16] and digits[17] == digits[18] and digits[17].startswith("44")
    assert re.fullmatch(r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}", got[10]) and re.fullmatch(r"\+44 [0-9]{2} [0-9]{4} [0-9]{4}", got[17])
