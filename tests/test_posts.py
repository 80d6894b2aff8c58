import json

from pyspark.sql import functions as F

from attesta.functions import posts as P
from attesta.functions import text as T
from attesta.functions import urls as U
from attesta.operators import posts as O
from attesta.registry import post_values as V
from attesta.sources import html as H
from attesta.sources.blocks import manual_paragraphs

JOB = {
    "@type": ["JobPosting", "Offer"], "title": "Caf&eacute; Systems Engineer", "datePosted": "2025-03-09", "hiringOrganization": {"name": "Blue &amp; Sons"},
    "jobLocation": {"address": {"addressLocality": "Pretoria", "addressCountry": {"name": "ZA"}}},
    "description": "&lt;div&gt;You need 1-3 years with Java and Docker.&lt;/div&gt;&lt;div&gt;A diploma would be preferred, and a link to your GitHub.&lt;/div&gt;",
}


def extract(spark, markup, track, url="https://jobs.example.co.za/1"):
    pages = spark.createDataFrame([(1, url, markup)], "page_id long, url string, html string")
    return O.extract_posts(H.parse_pages(pages).withColumn("track", F.lit(track)), F.lit("2026-01-01")).collect()[0]


def test_json_ld_post(spark):
    body = '<html><script type="application/ld+json">' + json.dumps([[{"b": []}], {"inner": JOB}]) + "</script><h1>Not this one</h1></html>"
    r = extract(spark, body, "SE Track")
    assert (r.title, r.company, r.location, r.date_posted) == ("Café Systems Engineer", "Blue & Sons", "Pretoria, ZA", "2025-03-09")
    assert (r.primary_skills, r.tools, r.experience_years) == ("Java", "Docker, Git/GitHub", "1-3")


def test_skills_need_their_words(spark):
    r = extract(spark, "<h1>Interface maker</h1><ul><li>You know Vue</li><li>You use Git daily</li></ul>", "SE Track")
    assert r.primary_skills == "" and r.secondary_skills == "Vue" and r.tools == "Git/GitHub"
    assert any("no programming language" in w for w in r.warnings)


def test_page_without_data(spark):
    page = "<header>Home</header><h1>Reporting Analyst</h1><p>The desk is in Durban, South Africa, two days remote, a hybrid week.</p><li>SQL is a must</li>"
    r = extract(spark, page, "DA Track")
    assert (r.title, r.location, r.work_type, r.primary_skills) == ("Reporting Analyst", "Durban, South Africa", "Hybrid", "SQL")


def test_plain_text_of_fields():
    assert H.plain_text("Caf&eacute; &ndash; Dev &#8217;x") == "Café – Dev ’x"
    assert H.plain_text("<p>One</p><nav>Menu</nav><p>Two</p>") == "One\nTwo"
    assert H.plain_text("  a \n b ") == "a b" and H.plain_text(None) == "" and H.plain_text(7) == "7"
    assert H.plain_fields({"a": ["&lt;"], "description": "&lt;"}) == {"a": ["<"], "description": "&lt;"}


def test_visible_blocks():
    got = H.visible_blocks('<head><p>x</p></head><p>a<p>b &amp; c</p><script>var t="</p>";</script><ul><li>one<br>two</li></ul><div>lost</div>')
    assert got == [("p", "b & c"), ("li", "one two")]


def test_page_reading():
    page = H.read_page('<meta property="og:title" content="T"><h1>Head</h1><p>Same</p><p>Same</p><p>Apply now</p><footer>f</footer>tail')
    assert page["paragraphs"] == ["Head", "Same", "tail"] and page["metadata"] == {"og:title": "T", "h1": "Head"}
    nested = H.read_page('a<nav>x<nav>y</nav>z<p>w</nav>b<script type="application/LD+json">{"k": 1}</script><script>s</script>c<script type="application/ld+json">[')
    assert nested["paragraphs"] == ["b c"] and nested["json_ld"] == ['{"k": 1}']


def shown(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(P.experience(F.col("t")).alias("x")).collect()[0].x.shown


def test_experience(spark):
    assert shown(spark, "min 3 years") == "3" and shown(spark, "at least 3 years") == "3+" and shown(spark, "up to 4 yrs") == "0-4"
    assert shown(spark, "nothing") == "Not specified" and shown(spark, "no experience required") == "0"
    # the number of the pattern counts into the position
    assert shown(spark, "2 years experience or 3+ years") == "2" and shown(spark, "5+ years") == "5+"


def test_portfolio_level_follows_the_sentence(spark):
    df = spark.createDataFrame([("A bonus. Please share your portfolio.",), ("Share your portfolio, optional\nx",), ("none",)], "t string")
    got = [tuple(r.x) for r in df.select(P.portfolio(F.col("t")).alias("x")).collect()]
    assert got == [("Y", "Required"), ("Y", "Preferred"), ("N", "Not Mentioned")]


def test_urls(spark):
    df = spark.createDataFrame([(" HTTPS://User@Münich.De:443/A/?q=1#f ",), ("http://h:81/x",), ("nothing",)], "u string")
    got = [r.n for r in df.select(U.normalize_submitted_url(F.col("u"), True).alias("n")).collect()]
    assert got == ["https://User@xn--mnich-kva.de/A/?q=1", "http://h:81/x", None]
    keys = [r.k for r in df.select(U.url_key(F.col("u")).alias("k")).collect()]
    assert keys[0] == "https://user@münich.de:443/A?q=1" and keys[1] == "http://h:81/x"


def test_required_text_is_in_every_match():
    assert P.required_text(r"\bhtml5?\b") == "html" and P.required_text(r"(?<!\w)c#(?!\w)") == "c#"
    assert P.required_text(r"\bon[- ]site\b|\bonsite\b") is None


def test_ids_go_on(spark):
    posts = spark.createDataFrame([(1, "SE Track"), (2, "SE Track"), (3, "DA Track")], "page_id long, track string")
    existing = spark.createDataFrame([("SE-009",), ("se-010",), ("EXAMPLE",)], "post_id string")
    got = {r.page_id: r.post_id for r in O.allocate_ids(posts, existing).collect()}
    assert got == {1: "SE-011", 2: "SE-012", 3: "DA-001"}


def test_has_words_agrees_with_the_count(spark):
    texts = ["", " ", "a " * 4, "a " * 5, "\x1c".join("vwxyz"), "\n" + "z　" * 5, "b\x1f" * 6, " c d e\tf", "x" * 50_000, None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    c = F.col("text")
    assert [tuple(r) for r in rows.select(T.has_words(c, 5), T.word_count(c) >= 5).collect()] == [(w, w) for w in (False, False, False, True, True, True, True, False, False, None)]


def test_places_are_only_searched_where_they_may_be(spark):
    texts = ["In PRETORİA now", "centurıon and Durban", "ſandton", "Cape Town, KwaZulu-Natal", "Durbanville", "none", None]
    rows = spark.createDataFrame([(t,) for t in texts], "body string")
    found = [r[0] for r in rows.select(P.places(F.col("body"), T.fold_case(F.concat(F.lit("Head\n"), "body")))).collect()]
    assert found == ["PRETORİA", "centurıon, Durban", "ſandton", "Cape Town, KwaZulu-Natal", "", "", ""]


ODD_TEXTS = [
    "ajava java, Java and JAVASCRIPT, java script; xjs js", "😀 java 😀 sql", "ß and ﬁ before java, git and GitHub",
    "İstanbul js. HYBRİD, remote role", "ſql before sql, gıt before git, mın 3 years", "on-ſite, ſql, Knowledge of k8s", "éjava ́java java", "_python python_ python",
    "dimensional modelling, statistics and statistic, power  bi", "ASP.NET .net x.net c# xc# c sharp", "problem-solving skills, problem solving",
    "Minimum of 3 years, mİnimum 2 yrs, 12 to 14 years, at least 5+ yrs", "a1 year 2 years of experience", "up to 4 yrs", "maximum of 7 years",
    "submit your github profile. code samples are required", "share a link to your portfolio", "Bachelors, bachelor's degree; xdiploma diploma", "",
    "ſkills and experİence that you muſt have, with benefits and cooKie talk about us",
]


def odd_rows(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(ODD_TEXTS)], "i int, text string")
    return rows.withColumn("low", T.fold_case(F.col("text")))


def test_search_from_the_first_place_finds_what_the_whole_search_finds(spark):
    text, low, whole = F.col("text"), F.col("low"), F.lit(False)
    patterns = [p for labels in V.VOCABULARIES.values() for ps in labels.values() for p in ps]
    phrases = (*V.SOFT_SKILLS, *V.READINESS)
    rows = odd_rows(spark).select(
        "i", P.aligned(text, low).alias("even"),
        F.array(*[P.first_position(text, (p,), low) for p in patterns]).alias("a"),
        F.array(*[P.first_position(text, (p,), low, whole) for p in patterns]).alias("b"),
        P.verbatim(text, phrases, low).alias("c"), P.verbatim(text, phrases, low, whole).alias("d"),
    ).collect()
    assert all(r.a == r.b and r.c == r.d for r in rows)
    # letters that folding takes apart, and letters beyond Java's units, are searched as a whole
    assert [rows[n].even for n in (0, 1, 3, 4)] == [True, False, False, False]
    assert sum(x is not None for r in rows for x in r.a) > 20
    assert P.leading_text(r"\bhtml5?\b") == "html" and P.leading_text(r"(?<!\w)\.net\b") == ".net"
    assert P.leading_text(r"\b(?:ms\s+)?excel\b") == "" and P.leading_text(r"\bgit\b|\bhg\b") == ""


def test_patterns_with_a_look_ahead_match_the_same(spark):
    told = [p for p, _ in V.YEARS] + [V.DEGREE, V.ROLE_WORDS, V.SENIOR, *V.PORTFOLIO]
    turned = [P.literal_first(p) for p in told]
    assert turned[0].startswith(r"(?=\d)") and turned[5].startswith("(?=[bdnt])")
    every = lambda ps: F.array(*[F.regexp_extract_all("text", F.lit(f"{P.ANY}({p})"), F.lit(0)) for p in ps])
    rows = odd_rows(spark).select(every(told).alias("a"), every(turned).alias("b")).collect()
    assert all(r.a == r.b for r in rows) and sum(len(x) for r in rows for x in r.a) > 8


def test_patterns_run_only_where_their_words_are(spark):
    text, low = F.col("text"), F.col("low")
    patterns = [p for _, p in V.WORK_TYPES] + [V.SE_FLAG, V.DA_FLAG, V.NO_EXPERIENCE]
    lower = F.lower("text")
    plain = F.regexp_count(text, F.lit(P.ANY + V.REQUIREMENT_WORDS)) * 4 - F.when(P.found(text, V.PAGE_TALK), 5).otherwise(0)
    rows = odd_rows(spark).select(
        F.array(*[P.found(text, p, low) for p in patterns]).alias("a"), F.array(*[P.found(text, p) for p in patterns]).alias("b"),
        P.requirement_score(text, lower, F.array().cast("array<string>")).alias("c"), plain.alias("d"),
        P.work_type(text, F.lit(""), low).alias("e"), P.work_type(text, F.lit("")).alias("f"),
    ).collect()
    assert all(r.a == r.b and r.c == r.d and r.e == r.f for r in rows)
    assert min(r.c for r in rows) < 0 or max(r.c for r in rows) > 0


def test_pasted_text_is_parted_once(spark):
    rows = spark.createDataFrame([("a\n\n• b  c\n\nd  e\x1cf",), ("\n\n",), (None,)], "raw string")
    parted = rows.select(manual_paragraphs(F.col("raw")).alias("p"))
    assert [r.p for r in parted.collect()] == [["a", "b c", "d e f"], [""], [None]]
    assert parted._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
