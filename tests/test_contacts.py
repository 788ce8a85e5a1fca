import pytest
from pyspark.sql import functions as F

from kalends.functions import text as T
from kalends.operators import contact_duplicates, contact_merge, rows, search
from kalends.sinks import csv, vcf
from kalends.sources.files import FILES
from kalends.sources.vcf import parse_vcf

CARDS = """BEGIN:VCARD
VERSION:3.0
FN:Ana Súarez
N:Súarez;Ana;Maria,Luz;Dr.;
EMAIL;TYPE=home,PREF:Ana@Example.com
EMAIL;TYPE=work:office@example.com
TEL;TYPE=cell:+351 912 345 678 ext. 5
ADR;TYPE=home:;;1 Road\\, East;Lisbon;;1000;Portugal
URL:javascript:alert(1)
URL:https://example.com/a
ORG:Acme;Research
NOTE:=danger\\nline
BDAY:--04-15
item1.X-LABEL:mine
PHOTO;ENCODING=b;TYPE=JPEG:QUJDRA==
UID:u1
END:VCARD
BEGIN:VCARD
VERSION:2.1
FN;CHARSET=ISO-8859-1;ENCODING=QUOTED-PRINTABLE:Jos=E9=
 Sil=
va
N;CHARSET=UTF-8;QUOTED-PRINTABLE:Silva;Jos=C3=A9
TEL;WORK:00351912345678
END:VCARD
BEGIN:VCARD
FN:Lost
"""


@pytest.fixture
def parsed(spark):
    return parse_vcf(spark.createDataFrame([(0, "a.vcf", CARDS.replace("\n", "\r\n")), (1, "b.vcf", "nothing")], FILES))


def test_contacts(parsed):
    ana, jose = parsed.contacts.orderBy("original_index").collect()
    assert (ana.id, ana.formatted_name, ana.given_name, ana.additional_names, ana.honorific_prefixes) == ("0:0:u1", "Ana Súarez", "Ana", ["Maria", "Luz"], ["Dr."])
    assert [(e.value, e.types, e.preference) for e in ana.emails] == [("Ana@Example.com", ["home"], 1), ("office@example.com", ["work"], None)]
    assert (ana.addresses[0].street, ana.addresses[0].country, [u.safe_protocol for u in ana.urls]) == ("1 Road, East", "Portugal", [False, True])
    assert (ana.organization, ana.organization_units, ana.notes, ana.birthday) == ("Acme", ["Research"], ["=danger\nline"], "--04-15")
    assert (ana.photo.kind, ana.photo.estimated_bytes, ana.logo) == ("embedded", 4, None)
    assert [(p.group, p.value) for p in ana.raw_properties if p.name == "X-LABEL"] == [("item1", "mine")]
    assert (jose.formatted_name, jose.version, jose.given_name, jose.family_name, jose.phones[0].types) == ("José Silva", "2.1", "José", "Silva", ["work"])
    codes = {(r.source_file, r.code) for r in parsed.diagnostics.collect()}
    assert codes >= {("a.vcf", "UNSAFE_URI"), ("a.vcf", "TRUNCATED_VCARD"), ("a.vcf", "UNSUPPORTED_BINARY_FIELD"), ("b.vcf", "MALFORMED_VCARD")}


def test_rows_and_search(parsed):
    long = rows.long_rows(parsed.contacts).where("id like '%u1'").collect()
    assert len(long) == 6
    row = rows.contact_rows(parsed.contacts).where("uid = 'u1'").first()
    assert row.notes == "'=danger\nline" and row.phones.startswith("+351") and row.organization == "Acme | Research"
    assert search.search_contacts(parsed.contacts, "suarez").count() == 1
    assert search.search_contacts(parsed.contacts, presence="email").count() == 1
    assert [r[0] for r in parsed.contacts.select(csv.cell(F.array_join("notes", ""))).collect()][0] in ('"=danger\nline"', "=danger\nline", "")


def test_round_trip(spark, parsed):
    texts = vcf.contact_text(parsed.contacts, ["source_index", "original_index"]).orderBy("original_index").collect()
    text = "\r\n".join(r.text for r in texts)
    assert max(len(x.encode()) for x in text.split("\r\n")) <= 75
    back = parse_vcf(spark.createDataFrame([(0, "a.vcf", text)], FILES)).contacts
    keep = ["formatted_name", "given_name", "family_name", "organization", "organization_units", "notes", "birthday"]
    assert back.select(*keep).orderBy("family_name").collect() == parsed.contacts.select(*keep).orderBy("family_name").collect()


def test_normalisers(spark):
    phones = {"+351 912-345-678": "+351912345678", "00351 912 345 678": "+351912345678", "912.345.678 ext. 12": "912345678x12", "1234": "", "call me": "", "(555) 010-2000x7": "5550102000x7"}
    df = spark.createDataFrame(list(phones.items()), "a string, b string")
    assert all(r.x == r.b for r in df.select(T.normalize_phone(F.col("a")).alias("x"), "b").collect())
    one = spark.range(1).select(T.normalize_name(F.lit("  José-María  O'Neil, Jr. ")), T.normalize_email(F.lit(" A+b.C@Ex.com ")), T.normalize_text(F.lit("Ａ　b  C")), T.protect_formula(F.lit(" =1")), T.is_safe_url(F.lit("HTTPS://a.b/"))).first()
    assert tuple(one) == ("jose-maria o'neil jr", "a+b.c@ex.com", "a b c", "' =1", True)


def contact(spark, people):
    """Contacts of (name, uid, email, phone, phone type)."""
    card = lambda n, u, e, p, t: f"BEGIN:VCARD\nVERSION:3.0\nFN:{n}\nN:{n.split()[-1]};{n.split()[0]}\n" + (f"UID:{u}\n" if u else "") + (f"EMAIL:{e}\n" if e else "") + (f"TEL;TYPE={t}:{p}\n" if p else "") + "END:VCARD"
    c = parse_vcf(spark.createDataFrame([(0, "a.vcf", "\n".join(card(*x) for x in people))], FILES)).contacts
    return c.withColumn("idx", F.col("original_index").cast("long"))


def test_duplicate_groups(spark):
    people = [
        ("Ann Lee", "", "ann@x.com", "", ""), ("Ann Lee", "", "ann@x.com", "", ""), ("Bob Ray", "", "bob@x.com", "+15550100001", "cell"), ("Robert Ray", "", "bob@x.com", "", ""),
        ("Cy One", "", "", "+15550100099", "work"), ("Dee Two", "", "", "+15550100099", "work"), ("Eve Ox", "same", "eve@x.com", "+15550100002", "cell"), ("Zed Quill", "same", "zed@x.com", "+15550100003", "cell"), ("Info A", "", "info@x.com", "", ""), ("Other B", "", "info@x.com", "", ""),
    ]
    found = contact_duplicates.find_duplicates(contact(spark, people))
    groups = {tuple(r.members): (r.confidence, r.exact) for r in found.groups.collect()}
    assert groups == {(0, 1): ("certain", True), (2, 3): ("likely", False), (6, 7): ("possible", False)}
    assert contact_duplicates.exact_copies(found.groups).first().copies == 1


def test_weak_buckets_and_group_caps(spark):
    same_name = contact(spark, [("Pat Doe", "", f"p{i}@x.com", "", "") for i in range(120)])
    found = contact_duplicates.find_duplicates(same_name)
    assert found.pairs.count() == 0 and {r.code for r in found.diagnostics.collect()} == {"DUPLICATE_BUCKET_TOO_LARGE"}
    assert found.metrics.first().weak_buckets_skipped == 1
    pairs = spark.createDataFrame([(0, i, 100 - i, "certain") for i in range(1, 8)], "a long, b long, score int, confidence string")
    capped, over = contact_duplicates.grouped(pairs, most=4)
    assert sorted(r.idx for r in capped.collect()) == [0, 1, 2, 3]
    assert [tuple(r) for r in over.collect()] == [("DUPLICATE_GROUP_LIMIT_REACHED", 0, 8)]


def test_a_cap_on_pairs_is_reported(spark):
    from dataclasses import replace

    from kalends.config import LIMITS

    people = contact(spark, [("Pat Doe", "", f"p{i}@x.com", "", "") for i in range(10)])
    found = contact_duplicates.find_duplicates(people, replace(LIMITS, candidate_pairs=20))
    assert [tuple(r) for r in found.diagnostics.collect()] == [("DUPLICATE_CANDIDATE_LIMIT_REACHED", 45)]
    assert found.metrics.first().candidate_pairs == 20
    assert contact_duplicates.find_duplicates(people).metrics.first().candidate_pairs == 45


def test_pairs_of_a_bucket_come_once_and_are_not_shuffled(spark, monkeypatch):
    from itertools import combinations

    shared = {i: [f"e{i % 3}@x.com", f"e{i % 4}@x.com", *(f"m{i // 2 * 2 + k}@x.com" for k in range(i % 5))] for i in range(40)}
    rows = [(i, 2, e, k) for i, own in shared.items() for k, e in enumerate(dict.fromkeys(own))] + [(i, 3, f"p{i % 6}", 0) for i in shared]
    keys = spark.createDataFrame(rows, "idx long, rank int, key string, position int")
    seen = {}
    for i, rank, key, _ in rows:
        seen.setdefault((rank, key), set()).add(i)
    want = {}
    for (rank, _), members in sorted(seen.items()):
        for a, b in combinations(sorted(members), 2):
            want.setdefault((a, b), rank)
    for carried in (64, 4, 0):  # contacts of more buckets go the other way
        monkeypatch.setattr(contact_duplicates, "CARRIED", carried)
        got = [tuple(r) for r in contact_duplicates.pair_seeds(keys)[0].collect()]
        assert len(got) == len(want) and {(a, b): rank for a, b, rank in got} == want, carried
    # 400 contacts of one address are 79,800 pairs; none of them goes through a shuffle
    monkeypatch.setattr(contact_duplicates, "CARRIED", 64)
    many = contact_duplicates.pair_seeds(spark.range(400).selectExpr("id as idx", "2 as rank", "'a@x.com' as key", "0 as position"))[0]
    store = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: sum(store.lastStageAttempt(k).shuffleWriteRecords() for k in range(before, after))
    ids = spark.sparkContext._jsc.sc().dagScheduler().nextStageId
    before = ids()
    assert many.write.format("noop").mode("overwrite").save() is None and many.count() == 79_800
    after = ids()
    assert written() < 20_000


def test_signature_is_of_all_fields(spark):
    def card(*lines):
        return "\n".join(["BEGIN:VCARD", "VERSION:3.0", "FN:Ann Lee", "N:Lee;Ann", "EMAIL;TYPE=home:ann@x.com", *lines, "END:VCARD"])

    others = ["ROLE:Boss", "URL:https://a.b/", "NICKNAME:An", "CATEGORIES:x", "ANNIVERSARY:2000-01-01", "GEO:1;2", "X-A:1", "EMAIL;TYPE=work:ann@x.com", "GENDER:F", "ORG:Acme;Unit", "TZ:UTC", "KIND:group", "NOTE:n"]
    text = "\n".join([card(), card().replace("Ann", "ANN"), card().replace("Lee;Ann", "Ｌｅｅ;Ann"), *map(card, others)])
    c = parse_vcf(spark.createDataFrame([(0, "a.vcf", text)], FILES)).contacts.withColumn("idx", F.col("original_index").cast("long"))
    got = [r.signature for r in contact_duplicates.prepared(c).orderBy("idx").collect()]
    assert got[0] == got[1] == got[2] and len(set(got[2:])) == len(others) + 1


def test_generic_mailboxes(spark):
    names = ["admin", "contact", "hello", "help", "info", "office", "sales", "support", "team", "webmaster", "enquiries", "mail", "ann"]
    rows = spark.createDataFrame([(f"{n}@x.com",) for n in names], "e string")
    assert [r[0] for r in rows.select(T.is_generic_mailbox(F.col("e"))).collect()] == [True] * 10 + [False] * 3


def test_escapes_are_read_in_one_pass(spark):
    rows = [("a\\nb", "a\nb"), ("a\\\\nb", "a\\nb"), ("\\,\\;\\x", ",;\\x"), ("\ue000", "\ue000"), ("\\\\\\,", "\\,"), ("", "")]
    df = spark.createDataFrame(rows, "raw string, want string")
    assert all(r.got == r.want for r in df.select("want", T.unescape_text(F.col("raw")).alias("got")).collect())


def test_merge_and_resolutions(spark):
    people = [("Ann Lee", "", "ann@x.com", "+15550100001", "cell"), ("Ann Lee", "u9", "ANN@x.com", "", ""), ("Bob Ray", "", "bob@x.com", "", "")]
    c = contact(spark, people)
    groups = spark.createDataFrame([(0, 0), (0, 1)], "group long, idx long")
    m = contact_merge.apply(c, groups).first()
    assert (m.version, m.uid, [e.value for e in m.emails], len(m.phones), m.formatted_name) == ("4.0", "u9", ["ann@x.com"], 1, "Ann Lee")
    choose = spark.createDataFrame([(0, "formatted_name", 1)], "group long, field string, idx long")
    assert contact_merge.apply(c, groups, choose).count() == 1
    log = lambda *types: spark.createDataFrame([(i, 0, t) for i, t in enumerate(types)], "seq long, group long, type string")
    last = lambda *types: [r.type for r in contact_merge.latest(log(*types)).collect()]
    assert last("merge", "keep") == ["keep"]
    assert last("merge", "keep", "undo") == ["merge"]
    assert last("merge", "keep", "undo", "undo") == []
    assert last("merge", "undo", "keep") == ["keep"]
    assert last("merge", "keep", "undo", "merge", "undo") == ["merge"]
    assert last("merge", "reset") == [] and last("merge", "reset", "keep") == ["keep"]
    kept = contact_merge.derive(c, groups, log("merge")).orderBy("position").collect()
    assert [(r.position, r.merged) for r in kept] == [(0, True), (2, False)]


def test_groups_by_decision(spark):
    from kalends.operators.contact_duplicates import filter_groups
    from kalends.operators.contact_merge import latest

    groups = spark.createDataFrame([(1, "certain", True), (2, "likely", False), (3, "certain", False)], "group long, confidence string, exact boolean")
    made = spark.createDataFrame([(1, 1, "merge"), (2, 2, "keep"), (3, 2, "undo"), (4, 3, "keep"), (5, 3, "merge")], "seq long, group long, type string")
    of = lambda **k: sorted(r.group for r in filter_groups(groups, decided=latest(made), **k).collect())
    assert of(resolved=True) == [1, 3] and of(resolved=False) == [2]
    assert of(confidence="certain", resolved=True, exact=False) == [3]
