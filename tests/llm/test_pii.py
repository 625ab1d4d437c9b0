import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwright.llm.pii import KINDS, base_spans, candidates, examples, features, find, find_pii, luhn, op6_boosted_candidates, redact, trained

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (16 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_base_spans_equal_the_patterns():
    r = random.Random(9)
    bits = ["@", ".", "a", "Bc", "9", "12", "255", "256", "007", "+", "-", " ", "(", ")", "é", "%", "_", "4111 1111 1111 1111", "4111111111111111", "1.2.3.4", "a@b.co", "+1 (407) 555-7710", "\n", "x@y@z.q"]
    for _ in range(20_000):
        text = "".join(r.choice(bits) for _ in range(r.randint(1, 14)))
        assert base_spans(text) == brute(text), repr(text)


@pytest.mark.parametrize("junk", ["a." * 200_000, "9" * 400_000, "1." * 200_000, "+1 " * 100_000, "a@" * 100_000, "(1 " * 50_000, "at dot " * 50_000, "1 " * 100_000, "a at b dot co " * 20_000, "x@" + "ab." * 100_000, "a" * 300_000 + " at b.co"], ids=lambda x: x[:6])
def test_work_on_long_junk_is_linear(junk):
    """Whole texts through the whole search: twice the text takes about twice the time."""
    seconds = []
    for part in (junk[: len(junk) // 2], junk):
        began = time.process_time()
        find(part, trained())
        seconds.append(time.process_time() - began)
    assert seconds[1] < 3 * seconds[0] + 0.5 and seconds[1] < 40


def test_overlaps_of_many_spans_are_linear():
    texts = ["call 407-555-7710, mail a@b.co and " * n for n in (3000, 6000)]
    seconds = []
    for text in texts:
        began = time.process_time()
        base, added = find(text, trained())
        seconds.append(time.process_time() - began)
    assert len(base) == 6000 and seconds[1] < 3 * seconds[0] + 0.5
    spans = sorted(x[1:3] for x in [*base, *added])
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


#: Written by hand, not by the templates that the trees learn from: what a person would redact, by kind, in running text.
REAL = {
    "email": [
        ("Questions? Send them to jane.doe [at] example [dot] org before Friday.", "jane.doe [at] example [dot] org"),
        ("You can reach our editor (m_keller(at)verlag.de) at any time.", "m_keller(at)verlag.de"),
        ("Bitte schreiben Sie an info {at} museum-koeln.de oder rufen Sie an.", "info {at} museum-koeln.de"),
        ("contact: sales(at)widgets(dot)com for a quote", "sales(at)widgets(dot)com"),
        ("mon adresse: paul.martin [at] univ-lyon.fr, merci", "paul.martin [at] univ-lyon.fr"),
        ("escríbeme a lucia_perez (at) correo.es cuando puedas", "lucia_perez (at) correo.es"),
        ("my email is bob77 [at] mailbox [dot] net thanks", "bob77 [at] mailbox [dot] net"),
        ("bugs go to dev-list[at]project[dot]io please", "dev-list[at]project[dot]io"),
        ("webmaster (at) city-council (dot) org (dot) uk runs the site", "webmaster (at) city-council (dot) org (dot) uk"),
        ("e-mail: anna @ kunsthaus.de", "anna @ kunsthaus.de"),
    ],
    "ip": [
        ("the attack came from 203[.]0[.]113[.]77 last night", "203[.]0[.]113[.]77"),
        ("server 198(.)51(.)100(.)23 answered slowly", "198(.)51(.)100(.)23"),
        ("login from host 192[.]0[.]2[.]146 was refused", "192[.]0[.]2[.]146"),
        ("blocked client 10 . 20 . 30 . 40 by hand", "10 . 20 . 30 . 40"),
        ("Adresse 172[.]16[.]254[.]1 im Protokoll", "172[.]16[.]254[.]1"),
        ("ip: 45[.]33[.]32[.]156 seen twice", "45[.]33[.]32[.]156"),
    ],
    "card": [
        ("paid by card 4539.1488.0343.6467 on Monday", "4539.1488.0343.6467"),
        ("my visa is 4485/2757/4230/8327, expires soon", "4485/2757/4230/8327"),
        ("credit card: 5425_2334_3010_9903 declined", "5425_2334_3010_9903"),
        ("amex 378282246310005 was charged twice", "378282246310005"),
        ("Karte 6011.1111.1111.1117 gesperrt", "6011.1111.1111.1117"),
        ("mastercard 5105.1051.0510.5100 for the hotel", "5105.1051.0510.5100"),
        ("the card ending was wrong: 30569309025904", "30569309025904"),
    ],
    "phone": [
        ("Call me at (212) 555-0143 tonight.", "(212) 555-0143"),
        ("office phone: 415-555-2671, ask for Sam", "415-555-2671"),
        ("Tel. 030 1234 5678 (Büro)", "030 1234 5678"),
        ("fax 0221/4567890 is out of order", "0221/4567890"),
        ("mobile 07700 900123 after six", "07700 900123"),
        ("dial 0044 20 7946 0018 from abroad", "0044 20 7946 0018"),
        ("whatsapp 617.555.0199 any time", "617.555.0199"),
        ("appelez le 01 42 68 53 00 avant midi", "01 42 68 53 00"),
        ("llámame al 912 345 678 mañana", "912 345 678"),
        ("cell: 303 555 0188", "303 555 0188"),
    ],
}
CLEAN = [
    "In 2019 we sold 1,250 units, up from 980 in 2018.", "See section 3.2.1.4 of the manual for details.", "The match ended 3-2 (1-1) before 45,000 people.",
    "ISBN 978-3-16-148410-0 is out of print.", "Order no. 4458120093 shipped on 2021-03-14 10:22.", "version 10.4.2.311 fixes the crash",
    "Invoice 2020-000123-77 is due 12.05.2021.", "They met at noon at the dot on the map.", "look at example dot matrix printers", "We stayed at hotel.com rooms for 3 nights.",
    "coordinates 52.5200 13.4050 mark the gate", "the sum 1234567 8901234 was transferred", "serial 9843 2231 0098 1123 is on the back", "pages 112-118, 203-211 and 340-355",
    "price 1 299 000 or 1.299.000 in total", "2 @ 4.50 each makes 9", "from 1998/99 until 2003/04", "build 20230114.1530.22 passed", "ratio 16:9, 1920 1080 at 60", "timestamps 1617181920 and 1617181999",
    "ticket 88123456789 was closed", "chapter 12 34 56 78 90 of the old list", "Highway 101, exit 432, 7 miles", "the year 1905 1906 1907 1908 series", "isbn 0 306 40615 2", "ref 5500.1200.7730.0001 in the ledger",
]


def test_cases_written_by_hand():
    """Precision and recall by kind on cases that no template made."""
    found = {kind: [] for kind in KINDS}
    for kind, cases in REAL.items():
        for text, want in cases:
            added = [(k, text[s:e]) for k, s, e, _ in find(text, trained())[1]]
            found[kind] += [((kind, want) in added, len(added) - ((kind, want) in added))]
    recall = {kind: np.mean([hit for hit, _ in x]) for kind, x in found.items()}
    right, wrong = sum(hit for x in found.values() for hit, _ in x), sum(n for x in found.values() for _, n in x) + sum(len(find(t, trained())[1]) for t in CLEAN)
    print(recall, right, wrong)
    assert recall["email"] >= 0.9 and recall["ip"] >= 0.8 and recall["card"] >= 0.9 and recall["phone"] >= 0.7
    assert right / (right + wrong) >= 0.95


def test_model_on_invented_cases_of_its_own():
    model = trained()
    rows = examples(2000, 99)
    x, y = np.array([features(*c[:4]) for c in rows], float), np.array([c[4] for c in rows])
    p = model.probabilities(x)
    chosen = np.array([p[i] >= model.thresholds[rows[i][1]] for i in range(len(rows))])
    assert (y[chosen] == 1).mean() > 0.97 and chosen[y == 1].mean() > 0.5
    assert abs(p.mean() - y.mean()) < 0.05
    kinds = {rows[i][1] for i in np.flatnonzero(chosen)}
    assert kinds == set(KINDS)


@pytest.mark.parametrize("text", ["call (407) 555-7710 now", "email: anna.b [at] tionlich [dot] com"])
def test_added_spans(text):
    base, added = find(text, trained())
    assert not base and len(added) == 1


@pytest.mark.parametrize(
    "text, want",
    [
        ("call 407-555-7710 212-555-0199 now", ["407-555-7710", "212-555-0199"]),
        ("phone (407) 555-7710 12/05/2024", ["(407) 555-7710"]),
        ("tel " + "407-555-7710 212-555-0199 " * 40, ["407-555-7710", "212-555-0199"] * 40),
        ("card 4111.1111.1111.1111 (407) 555-7710", ["4111.1111.1111.1111", "(407) 555-7710"]),
        ("un. +1 (843) 555-7672 170.106.47.218 de", ["+1 (843) 555-7672"]),  # which the base pattern takes as one number, and drops
    ],
)
def test_numbers_next_to_each_other(text, want):
    base, added = find(text, trained())
    assert {k for k, *_ in base} <= {"ip"} and [text[s:e] for _, s, e, _ in sorted(added, key=lambda x: x[1])] == want


def test_every_run_of_groups_is_proposed():
    assert {"12 (407) 555-7710", "(407) 555-7710", "555-7710"} <= {text[s:e] for text in ["room 12 (407) 555-7710"] for _, s, e in candidates(text)}
    r = random.Random(2)
    for _ in range(300):
        groups = ["9" * r.randint(1, 21 if r.random() < 0.1 else 5) for _ in range(r.randint(1, 30))]
        text, ends = "", []
        for g in groups:
            text += r.choice([" ", "-", ". "]) + g
            ends.append((len(text) - len(g), len(text)))
        want = {(kind, ends[i][0], ends[j][1]) for i in range(len(groups)) for j in range(i, len(groups)) for kind, low, high in (("phone", 7, 15), ("card", 13, 19)) if low <= sum(map(len, groups[i : j + 1])) <= high}
        got = [c for c in candidates(text) if c[0] != "ip"]
        assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("text", ["order 20240101123456", "version 1.2.3", "the thing at the dot of day", "ref 9915074521380047 of", "on 2024-01-02 10", "", None, "no digits"])
def test_clean_texts(text):
    assert find(text, trained()) == ([], [])


def test_frame(spark):
    rows = [(1, "mail a@b.co or +1 (407) 555-7710", "x"), (2, None, "y"), (None, "", "z"), (3, "é 1.2.3.4, 4111 1111 1111 1111", "w"), (3, "é 1.2.3.4, 4111 1111 1111 1111", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = find_pii(df).collect()
    assert [x.spans for x in got] == ["email:5:11,phone:15:32", "", "", "ip:2:9,card:11:30", "ip:2:9,card:11:30"]
    assert [tuple(x)[2:6] for x in got] == [(1, 0, 0, 1), (0, 0, 0, 0), (0, 0, 0, 0), (0, 1, 1, 0), (0, 1, 1, 0)]
    assert [x.text for x in redact(df).collect()][:4] == ["mail [EMAIL] or [PHONE]", None, "", "é [IP], [CARD]"]
    assert find_pii(df.filter(F.lit(False))).count() == 0


def test_table_against_the_patterns(spark):
    docs = {x.doc_id: x.text for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = op6_boosted_candidates(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(docs)
    for x in got:
        want = brute(docs[x.doc_id])
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(k == kind for k, *_ in want) for kind in KINDS]
        assert {f"{k}:{s}:{e}" for k, s, e in want} <= set(x.spans.split(","))
