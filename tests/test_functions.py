import pytest
from pyspark.sql import functions as F

from goldweave.functions import normalize as N
from goldweave.functions import similarity as S
from goldweave.functions import text as T

CASES = [
    (N.normalize_name, [("john doe", "John Doe"), ("Dr. Ann  Lee, PhD", "Ann Lee"), ("  o'neil   jean-luc ", "O'Neil Jean-Luc"), (None, "Unknown Candidate"), ("", "Unknown Candidate"), ("José (Pepe) Ruíz", "José Ruíz"), ("李小龙", "李小龙"), ("Mr.", "Unknown Candidate")]),
    (N.normalize_email, [(" A@B.Org ", "a@b.org"), ("nobody.org", None), (None, None), ("", None)]),
    (lambda c: N.normalize_phone(c, "US"), [("2024561111", "+12024561111"), ("+91 98765 43210", "+919876543210"), ("00919876543210", "+919876543210"), ("(555) 123-4567", "+15551234567"), ("1234567890", None), ("1111111111", None), ("9876543210", None), ("202-456-1111 ext 12", "+12024561111"), ("123", None), (None, None)]),
    (N.normalize_phone, [("2024561111", "+912024561111"), ("98765432101", "+98765432101")]),
    (N.normalize_date, [("Present", None), ("current", None), ("currently working", None), ("2020-05", "2020-05"), ("05/2018", "2018-05"), ("5/2018", "2018-05"), ("Jan 2020", "2020-01"), ("December 2023", "2023-12"), ("2015", "2015-01"), ("13/2020", "2020-13"), (" soon ", "soon"), (None, None), ("", None)]),
    (N.normalize_country, [("United States", "US"), ("usa", "US"), ("U.S.A.", "US"), ("bharat", "IN"), ("germany", "DE"), ("England", "GB"), ("Atlantis", "AT"), (None, None)]),
    (N.normalize_skill, [("js", "JavaScript"), ("python3", "Python"), ("docker-compose", "Docker"), ("aws", "AWS"), ("cicd", "CI/CD"), (" Weaving ", "Weaving")]),
    (N.normalize_url, [("linkedin.com/in/a?x=1", "https://linkedin.com/in/a"), ("http://github.com/a", "http://github.com/a"), ("x.dev?q=1", "https://x.dev?q=1"), (None, None)]),
    (T.full_name, [("Candidate: Mira Quell\nmore", "Mira Quell"), ("\nMira Quell\nx", "Mira Quell"), ("Resume page\nmira@x.org y\nMira B Quell", "Mira B Quell"), ("one\ntwo\nthree\nMira Quell", None)]),
    (T.emails, [("write to a @ b.com now, or a@b.com. Then rest", ["a@b.com"]), ("none", [])]),
    (lambda c: T.emails(c, guard=False), [("mail a@b.com. Then", ["a@b.com.Then"])]),
    (T.phones, [("call +91 98765 43210 or 202-456-1111", ["+91 98765 43210", "202-456-1111"])]),
    (T.linkedin, [("see linkedin.com/in/a-b", "https://linkedin.com/in/a-b"), ("nothing", None)]),
    (T.portfolio, [("a.dev x https://me.io/x, https://linkedin.com/in/q", "https://me.io/x"), ("mail gmail.com and site my.org", "my.org")]),
    (T.other_links, [("https://me.io https://b.dev. https://c.dev https://b.dev", ["https://b.dev", "https://c.dev"])]),
    (T.skills, [("C++ and c#, node; going to Go.", ["C++", "C#", "Go"]), ("javascripts", [])]),
    (T.headline, [("Summary\nBuilds  looms\nand more\n\nExperience\nx", "Builds looms and more"), ("Summary: no", None)]),
    (T.location, [("Location: Pune, Maharashtra, India", ["Pune", "Maharashtra", "India"]), ("based in Chennai, Tamil Nadu", ["Chennai", "Tamil Nadu", "IN"]), ("he likes london", ["London", None, "GB"]), ("nowhere", [None, None, None])]),
]


@pytest.mark.parametrize("f, pairs", CASES, ids=lambda x: getattr(x, "__name__", ""))
def test_cases(spark, f, pairs):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(pairs)], "i int, a string")
    got = [r.v for r in df.select("i", f(F.col("a")).alias("v")).orderBy("i").collect()]
    assert got == [b for _, b in pairs]


EDUCATION = [
    ("Education\nMS in Weaving\nHill University\n2011 - 2015\n\nSkills\n", ("Hill University", "MS", "Weaving\nHill University", 2015)),
    ("Education\nB.Tech\n2019 - present\n\nSkills\n", ("2019 - present", "B.Tech", None, None)),
    ("Education\nPhD\n\nSkills\n", ("Unknown Institution", "PhD", None, None)),
]


@pytest.mark.parametrize("text, want", EDUCATION)
def test_education(spark, text, want):
    r = spark.createDataFrame([(text,)], "t string").select(F.inline(T.education(F.col("t")))).first()
    assert (r.institution, r.degree, r.end_year) == (want[0], want[1], want[3])


def test_experience_and_years(spark):
    text = "Experience\nEngineer at Blue Fern\nJan 2020 - Present\nDid things\n\nTall Oak\n2015-03 to 2019-12\n\nEducation\nx"
    df = spark.createDataFrame([(text,)], "t string")
    jobs = df.select(F.inline(T.experience(F.col("t")))).collect()
    assert [tuple(j) for j in jobs] == [("Blue Fern", "Engineer", "Jan 2020", "Present", "Jan 2020 - Present Did things"), ("Tall Oak", "Unknown Title", "2015-03", "2019-12", "2015-03 to 2019-12")]
    assert df.select(T.years_of(T.experience(F.col("t"))).alias("y")).first().y == 10.0


def test_similarities(spark):
    pairs = [("martha", "marhta", 0.9611), ("google", "google llc", 0.92), ("abzzqq", "abyyxxkkll", 0.5111), ("abcdefgh", "abcdefxy", 0.9), ("google", "microsoft", 0.426), ("", "a", 0.0), (None, "a", 0.0)]
    df = spark.createDataFrame(pairs, "a string, b string, want double")
    for r in df.withColumn("got", S.jaro_winkler_similarity(F.col("a"), F.col("b"))).collect():
        assert r.got == pytest.approx(r.want, abs=1e-3)
    score = S.match_score(F.lit("John Doe"), F.lit("jon doe"), F.lit(None).cast("string"), F.lit("x"))
    r = spark.range(1).select(score.alias("s"), S.match_status(score).alias("k"), S.match_status(F.lit(0.65)).alias("p"), S.match_status(F.lit(0.64)).alias("n")).first()
    assert (round(r.s, 3), r.k, r.p, r.n) == (0.875, "CONFIRMED", "PROBABLE_MANUAL_REVIEW", "NO_MATCH")
