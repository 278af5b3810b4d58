"""Hand-made pages in the shapes the boards publish."""

import pytest

from jobloom.functions import html as H
from jobloom.operators import pages as P
from jobloom.plans.fixtures import as_of
from jobloom.plans.pipeline import source_postings
from jobloom.sources.profiles import PROFILES


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "url string, html string")


# board -> (listing url, listing html, posting url, posting html, expected canonical fields)
BOARDS = {
    "jobinrwanda": (
        "https://www.jobinrwanda.com/jobs",
        '<div class="card"><a href="/job/nurse-1"><span class="field--name-title">Senior Nurse</span></a>'
        '<p class="card-text"><a href="/employer/big-clinic">x</a> | Huye | Experience: 2 years | Published: 01-03-2026 |</p>'
        '<time>on 27-03-2026</time><span class="badge">Full-time</span></div>',
        "https://www.jobinrwanda.com/job/nurse-1",
        '<ul class="list-group"><li>Sector: Health</li><li>Location: Musanze</li><li>Education: Bachelor</li><li>Experience: 3 to 5 years</li></ul>'
        '<div class="field--name-field-job-full-description">Care for patients. Salary RWF 500,000 - 600,000</div>',
        {"title": "Senior Nurse", "company": "Big Clinic", "district": "Musanze", "sector": "Health", "employment_type": "Full-time",
         "experience_years": "3-5", "education_level": "Bachelor's", "salary_disclosed": True, "deadline": "on 27-03-2026",
         "source_job_id": "nurse-1", "job_level": "Senior"},
    ),
    "newtimesjobs": (
        "https://jobs.newtimes.co.rw/jobs/search/tenders",
        '<div class="job-listing"><a href="/jobs/501-supply">Supply of fuel at Bank of Kigali</a> | Published on 11-02-2026 | Deadline 25-02-2026</div>',
        "https://jobs.newtimes.co.rw/jobs/501-supply",
        "<h1>Supply of fuel</h1><main><nav>Home</nav><p>" + "The bank invites bids for fuel supply. " * 6 + "</p></main>",
        {"title": "Supply of fuel", "company": "Bank of Kigali", "sector": "Tender", "posted_date": "2026-02-11", "deadline": "2026-02-25",
         "source_job_id": "501", "district": "", "eligibility_reason": "Listed on jobs.newtimes.co.rw"},
    ),
    "greatrwandajobs": (
        "https://www.greatrwandajobs.com/jobs/",
        '<div class="jsjob"><img alt="Acme Co"><a href="/jobs/job-detail/job-cook-77">Cook</a> Job Category: Hospitality Posted: 3 Days Ago '
        "Deadline of this Job: 08th March 2026 Duty Station: Remera | Kigali | Rwanda</div>",
        "https://www.greatrwandajobs.com/jobs/job-detail/job-cook-77",
        '<a href="/jobs/company-detail/acme" title="Acme Ltd">x</a><div class="item-page">Cook meals, 2+ years. Contract.</div><a href="mailto:hr@acme.example">write</a>',
        {"title": "Cook", "company": "Acme Ltd", "posted_date": "2026-02-26", "deadline": "2026-03-08", "source_job_id": "77",
         "district": "Kigali", "experience_years": "2+", "employment_type": "Contract"},
    ),
    "jobskazi": (
        "https://rw.jobskazi.com/",
        '<li class="job_listing"><a href="/job/agronomist-1/"><img alt="Logo Co"><h3>Agronomist</h3><ul><li>Huye</li><li>Green Farm</li>'
        "<li>Contract</li><li>Full Time</li></ul> Posted 3 days ago</a></li>",
        "https://rw.jobskazi.com/job/agronomist-1/",
        '<strong>Green Farm Ltd</strong><a href="https://maps.google.com/x">Nyagatare</a><div class="job_description">Grow crops. Closing date: 15/03/2026</div>',
        {"title": "Agronomist", "company": "Green Farm Ltd", "district": "Nyagatare", "posted_date": "on 26-02-2026", "deadline": "15/03/2026",
         "sector": "Agriculture", "employment_type": "Full-time"},
    ),
    "unjobs": (
        "https://unjobs.org/duty_stations/kgl",
        '<div class="job"><a class="jtitle" href="https://unjobs.org/vacancies/9">Data Officer, P4, Kigali, Rwanda, #0012</a><br>WFP | Deadline: 7 January 2026</div>',
        None, None,
        {"title": "Data Officer", "company": "WFP", "job_level": "Senior", "employment_type": "Contract", "deadline": "7 January 2026",
         "sector": "NGO", "district": "Kigali", "source_job_id": "9", "confidence_score": 5},
    ),
    "impactpool": (
        "https://www.impactpool.org/countries/Rwanda",
        '<a href="/jobs/55"><img src="/cdn/logo.png" alt="UNDP"><div>Climate Intern</div><div>UNDP</div><div>Nairobi | Kigali</div><div>Internship - Junior level</div></a>',
        "https://www.impactpool.org/jobs/55",
        "<title>Climate Intern | UN Development | Pool</title><h1>Climate Intern</h1><main>Work on climate. Application deadline: March 20, 2026 (6 days)</main>",
        {"title": "Climate Intern", "company": "UN Development", "job_level": "Entry", "employment_type": "Internship", "district": "Kigali",
         "deadline": "March 20, 2026"},
    ),
    "jobnziza": (
        "https://jobnziza.com/latest-jobs?category=internship",
        '<a href="/read_job_post.php?slug=loan-officer"><h5>Loan Officer</h5><h6>SACCO</h6></a> Location: Kigali , Rwanda Published: 18/03/2026 Deadline: 19/04/2026 17:00',
        "https://jobnziza.com/read_job_post.php?slug=loan-officer",
        "<h4>Loan Officer</h4><h5>Icyerekezo SACCO</h5><p>Location: Huye , Rwanda Type: Full-time Education: Bachelor's Degree (A0) Experience: 2-3 years Deadline: 19/04/2026 Posted: 18/03/2026</p>"
        '<div class="job-body">Lend money.</div>',
        {"title": "Loan Officer", "company": "Icyerekezo SACCO", "district": "Huye", "employment_type": "Full-time", "education_level": "Bachelor's",
         "experience_years": "2-3", "deadline": "on 19-04-2026", "posted_date": "on 18-03-2026", "source_job_id": "loan-officer"},
    ),
    "jobwebrwanda": (
        "https://jobwebrwanda.com/jobs/",
        '<ol><li><strong><a href="https://jobwebrwanda.com/jobs/it-manager/">IT Manager at Soft Ltd</a></strong><span>Part-Time</span> Location: Butaro Date 5/Mar/2026</li></ol>',
        None, None,
        {"title": "IT Manager", "company": "Soft Ltd", "employment_type": "Part-time", "district": "Butaro", "posted_date": "2026-03-05",
         "sector": "IT", "job_level": "Senior", "confidence_score": 5},
    ),
}


@pytest.mark.parametrize("name", BOARDS)
def test_board(spark, name):
    lurl, lhtml, purl, phtml, want = BOARDS[name]
    posts = frame(spark, (purl, phtml)) if purl else None
    # the same card on a second page counts once
    listing = frame(spark, (lurl, lhtml), (lurl + ("&" if "?" in lurl else "?") + "page=2", lhtml))
    rows = source_postings(PROFILES[name], listing, posts, as_of()).collect()
    assert len(rows) == 1
    got = rows[0].asDict()
    assert {k: got[k] for k in want} == want


def test_announcement_board(spark):
    body = "We are hiring for<br>1. Staff Nurse<br>2. Truck Driver<br>3. Senior Accountant<br>Location: Kigali city. Deadline: 15 March 2026"
    page = f'<article><h1>10 Job Positions at NISR: (Deadline Ongoing)</h1><time datetime="2026-03-01">x</time><div class="entry-content">{body}</div></article>'
    rows = source_postings(PROFILES["mucuruzi"], None, frame(spark, ("https://mucuruzi.com/nisr/", page)), as_of()).collect()
    assert sorted(r.title for r in rows) == ["Senior Accountant", "Staff Nurse", "Truck Driver"]
    assert {r.company for r in rows} == {"NISR"} and len({r.id for r in rows}) == 3 and {r.deadline for r in rows} == {"Ongoing"}


def test_archive_roundup_and_pager(spark):
    base = "https://mucuruzi.com"
    html = f'<article><h2><a href="{base}/nurse/">Nurse  at X</a></h2></article><article><a href="https://other.example/">no</a></article>'
    fallback = f'<main><h3><a href="{base}/cook/">Cook</a></h3></main>'
    got = P.archive_stubs(frame(spark, ("a", html), ("b", fallback)), base).select("url", "source_url", "title").collect()
    assert sorted(map(tuple, got)) == [("a", base + "/nurse/", "Nurse at X"), ("b", base + "/cook/", "Cook")]
    body = f'<a href="{base}/one/">1</a> see {base}/two, and {base}/tag/x/ {base}/one/'
    links = {r.source_url for r in P.roundup_links(frame(spark, ("r", body)), base).collect()}
    assert links == {base + "/one/", base + "/two", base + "/one"}
    pager = P.expand_pager(frame(spark, ("https://x/j?c=1", '<li class="pager__item"><a href="?c=1&page=2">')))
    assert [r.page_url for r in pager.orderBy("page").collect()] == ["https://x/j?c=1", "https://x/j?c=1&page=1", "https://x/j?c=1&page=2"]
    assert P.expand_offsets(frame(spark, ("u", "Total jobs: 1,234")), 50).count() == 25


def test_cascades(spark):
    df = frame(spark, ("u", "<main><nav>menu</nav><p>tiny</p><p>" + "word " * 60 + "</p></main>"), ("v", "<div>Company: Acme | x</div>"))
    rows = {r.url: r for r in df.select("url", H.describe("html", H.visible_text("html")).alias("d"), H.company_of("html", H.text_of("html")).alias("c")).collect()}
    assert rows["u"].d.startswith("word word") and "menu" not in rows["u"].d and rows["v"].c == "Acme"


def test_plain_listing(spark):
    text = "noise\nStatistician\nMinistry (MOF-A)\nAPPLY\nLevel:5\nPosts:2\nUnder Statute\nPosted on\nMar 1, 2026\nDeadline\nMar 14, 2026\nend"
    row = P.plain_listing(spark.createDataFrame([(text,)], "text string")).head()
    assert (row.title, row.company, row.contract, row.deadline) == ("Statistician", "Ministry (MOF-A)", "Under Statute", "Mar 14, 2026")


def test_government_details(spark):
    from jobloom.functions import extract as X

    text = "Top\nJob responsibilities\nDuties and Responsibilities: plan\nQualifications\n1. Bachelor in Law\nother\n2. PhD\n5 years of relevant experience\nend"
    df = spark.createDataFrame([(text,)], "t string").select(X.duties("t").alias("d"), X.qualification_lines("t").alias("q"))
    r = df.head()
    assert r.d == "plan" and r.q.qualifications == "1. Bachelor in Law | 2. PhD | 5 years of relevant experience"
    assert r.q.education == "PhD" and r.q.experience == "5 years"
