"""Queries on listings: items of all providers built from the driver's tables, scans, resolution, merge, history and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed
from .functions import latex, similarity, text, urls
from .operators import evaluate, history, merge, resolve
from .plans import payloads, scan
from .registry import query, t
from .session import dealt, spread
from .sources import datasource, providers

def none() -> Column:
    return F.lit(None).cast("string")


def _cases(number: Column, *values: Column | str | None) -> Column:
    """The value of a number, from 0; the rest is the last."""
    out = F.when(F.lit(False), none())
    for i, v in enumerate(values):
        out = out.when(number == i, F.lit(v) if not isinstance(v, Column) else v)
    return out


def _json(fields: dict[str, Column | str | None]) -> Column:
    return F.to_json(F.struct(*((v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items())))


@query("""WITH p AS (SELECT *, p_partkey % 2 = 0 AS even, CASE p_partkey % 3 WHEN 0 THEN 'Hybrid' WHEN 1 THEN 'Remote' ELSE 'On-site' END AS mode,
  CASE WHEN p_partkey % 7 = 0 THEN 'competitive pay' WHEN p_partkey % 2 = 0 THEN 'EUR ' || format('{:,}', p_size * 1000) || '-' || format('{:,}', p_size * 1000 + 5000) || ' / year' ELSE 'EUR ' || format('{:,}', p_size * 1000) || ' / year' END AS pay,
  '4.5' || CASE WHEN p_partkey % 2 = 0 THEN ' (' || p_size || ' reviews)' ELSE '' END AS rating FROM part)
SELECT CAST(p_partkey AS VARCHAR) AS job_id, p_name AS title, p_brand AS company, CASE p_partkey % 3 WHEN 0 THEN p_type || ', BE, Germany' WHEN 1 THEN 'Road 1' ELSE 'Berlin' END AS location,
  CASE WHEN even THEN 'Full-time' ELSE 'Contract' END AS job_type, pay AS salary, mode AS work_mode, 'Python|Data analysis' AS skills, '2026-05-06' AS posted, 'https://de.indeed.com/viewjob?jk=' || p_partkey AS job_url, 'https://apply.example/' || p_partkey AS apply_url,
  CASE WHEN even THEN 51 ELSE p_size END::BIGINT AS applicant_count, 'Indeed' AS source_label,
  'Build ' || p_name || chr(10) || chr(10) || concat_ws(chr(10), 'Indeed structured metadata:', '- Salary: ' || pay, '- Work mode: ' || mode, '- Seniority: Senior level', '- Employer rating: ' || rating, '- Company size: ' || p_size, '- Industry: ' || p_type,
    '- Skills: Python, Data analysis', '- Programming languages: Python', '- Experience: 3+ years experience', '- Education: Bachelor degree', '- Benefits: Health insurance') AS description,
  '{"name":"' || p_brand || '","industry":"' || p_type || '","employeesCount":' || p_size || ',"ratingsValue":4.5' || CASE WHEN even THEN ',"ratingsCount":' || p_size ELSE '' END || '}' AS company_details,
  '{"salary":"' || pay || '","benefits":["Health insurance"],"skills":["Python","Data analysis"],"programming_languages":["Python"],"remote_work":"' || mode || '","seniority":"Senior level","experience_requirements":["3+ years experience"],"education_requirements":["Bachelor degree"],"employer_rating":"' || rating || '","company_size":"' || p_size || '","industry":"' || p_type || '"}' AS metadata
FROM p""")
def q56_indeed_items(s, d):
    """Every alias of the id, places as an object or a text, salaries as a range or a text, tags as objects and lists."""
    n, key, even = F.col("p_partkey"), F.col("p_partkey").cast("string"), F.col("p_partkey") % 2 == 0
    low = F.col("p_size") * 1000
    employer = F.struct(F.col("p_brand").alias("name"), F.col("p_type").alias("industry"), F.col("p_size").alias("employeesCount"), F.lit(4.5).alias("ratingsValue"), F.when(even, F.col("p_size")).alias("ratingsCount"), F.lit("").alias("relativeCompanyPageUrl"))
    place = lambda *f: F.to_json(F.struct(*(v.alias(k) for k, v in f)))
    location = _cases(n % 3, place(("city", F.col("p_type")), ("admin1Code", F.lit("BE")), ("countryName", F.lit("Germany"))), place(("streetAddress", F.lit("Road 1"))), '"Berlin"')
    tags = F.create_map(*(F.lit(x) for kv in {"x": "Python", "b": "3+ years experience", "c": "Senior level", "d": "Data analysis", "e": "Bachelor degree"}.items() for x in kv), F.lit("a"), _cases(n % 3, "Hybrid work", "Remote", "On-site"))
    pay = F.when(n % 7 != 0, F.struct(low.alias("minValue"), F.when(even, F.concat((low + 5000).cast("string"), F.lit(""))).alias("maxValue"), F.lit("EUR").alias("currencyCode"), F.lit("YEAR").alias("unitOfWork")))
    body = _json({
        "key": F.when(n % 4 == 0, key), "jobKey": F.when(n % 4 == 1, n), "id": F.when(n % 4 == 3, key), "url": F.concat(F.lit("https://de.indeed.com/viewjob?jk="), key), "jobUrl": F.concat(F.lit("https://apply.example/"), key),
        "title": F.when(n % 5 != 0, F.col("p_name")), "name": F.concat(F.lit(" "), F.col("p_name"), F.lit("  ")), "employer": employer, "description": F.struct(F.concat(F.lit("Build "), F.col("p_name")).alias("text")), "dateOnIndeed": "2026-05-06",
        "baseSalary": pay, "salary": F.when(n % 7 == 0, F.lit("competitive pay")), "jobTypes": F.when(even, F.create_map(F.lit("z"), F.lit("Full-time"), F.lit("a"), F.lit("full-TIME"))), "employerAttributes": F.when(~even, F.array(F.lit("Contract"), F.lit("Nice team"))),
        "attributes": tags, "benefits": F.array(F.lit("Health insurance"), F.lit("Health  Insurance")), "applicantsCount": F.when(even, F.lit("Over 50 applicants")), "applicants": F.struct(F.col("p_size").alias("count")),
    })
    item = F.concat(F.lit('{"location":'), location, F.lit(","), F.substring(body, F.lit(2), F.length(body)))
    rows = providers.normalise(dealt(t(s, d, "part"), "p_partkey").select(item.alias("json")), "indeed")
    return rows.select("job_id", "title", "company", "location", "job_type", "salary", "work_mode", F.array_join("skills", "|").alias("skills"), "posted", "job_url", "apply_url", "applicant_count", "source_label", "description", "company_details", "metadata")


@query("""WITH p AS (SELECT *, s_suppkey AS k, CASE s_suppkey % 4 WHEN 0 THEN 'EUR 60,000.5 / year' WHEN 1 THEN '70,000 / year' WHEN 2 THEN '50k' END AS pay,
  CASE WHEN s_suppkey % 3 = 0 THEN 'Hybrid' WHEN s_suppkey % 2 = 0 THEN 'Work from home available' WHEN s_suppkey % 3 = 2 THEN 'On-site' END AS mode FROM supplier)
SELECT CAST(k AS VARCHAR) AS job_id, s_name || ' (Full-time)' AS title, 'GeoCo ' || s_nationkey AS company, CASE k % 3 WHEN 0 THEN 'Hybrid Berlin' WHEN 1 THEN 'Berlin' ELSE 'Vor Ort Bonn' END AS location,
  CASE WHEN k % 5 = 0 THEN 'Teilzeit, Festanstellung' ELSE 'full-time' END AS job_type, pay AS salary, mode AS work_mode, 'SQL|GIS' AS skills, 'Schnelle Bewerbung|Top|Neu' AS tags, '2026-05-06' AS posted,
  'https://www.stepstone.de/stellenangebote--x--' || k || '-inline.html' AS job_url, 'https://www.stepstone.de/apply/' || k AS apply_url, 'https://co.example/' || s_nationkey AS company_url,
  'Do it now' || chr(10) || chr(10) || concat_ws(chr(10), 'Stepstone structured metadata:', '- Salary: ' || pay, '- Work mode: ' || mode, '- Skills: SQL, GIS', '- Category: IT', '- Labels: Schnelle Bewerbung, Top, Neu') AS description,
  '{"name":"GeoCo ' || s_nationkey || '","id":' || s_nationkey || ',"isAnonymous":false,"url":"https://co.example/' || s_nationkey || '"}' AS company_details,
  '{' || coalesce('"salary":"' || pay || '",', '') || coalesce('"work_mode":"' || mode || '",', '') || '"labels":["Schnelle Bewerbung","Top","Neu"],"skills":["SQL","GIS"],"category":"IT","company_id":"' || s_nationkey || '","company_url":"https://co.example/' || s_nationkey || '"' ||
    CASE WHEN k % 2 = 0 THEN ',"is_sponsored":true' ELSE '' END || ',"is_top_job":true,"is_partnership_job":true}' AS metadata
FROM p""")
def q57_stepstone_items(s, d):
    n, key = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    obj = lambda **f: F.struct(*(F.lit(v).alias(k) if not isinstance(v, Column) else v.alias(k) for k, v in f.items()))
    unified = F.when(n % 4 == 0, obj(min=F.lit("60,000.5"), max=F.lit("60000.50"), currency=F.lit("EUR"), period=F.lit("year"))).when(n % 4 == 1, obj(min=none(), max=F.lit("70000"), currency=none(), period=F.lit("year")))
    body = _json({
        "id": n, "title": F.concat(F.lit("<b>"), F.col("s_name"), F.lit("</b> (Full-time)")), "topLabels": F.array(F.lit("top"), F.lit("Neu")), "url": F.concat(F.lit("/stellenangebote--x--"), key, F.lit("-inline.html")),
        "applyUrl": F.concat(F.lit("apply/"), key), "companyName": F.concat(F.lit("GeoCo "), F.col("s_nationkey").cast("string")), "companyId": F.col("s_nationkey"), "companyUrl": F.concat(F.lit("https://co.example/"), F.col("s_nationkey").cast("string")), "isAnonymous": F.lit(False),
        "location": _cases(n % 3, "Hybrid Berlin", "Berlin", "Vor Ort Bonn"), "workFromHome": F.when(n % 2 == 0, F.lit(2)).otherwise(0), "unifiedSalary": unified, "salary": F.when(n % 4 == 2, F.lit("50k")), "category": "IT", "description": "<p>Do <i>it</i> now</p>",
        "isSponsored": F.when(n % 2 == 0, F.lit(1)).otherwise(0), "isTopJob": F.lit(True), "isHighlighted": F.lit(False), "partnership": obj(isPartnershipJob=F.lit(True)), "publishFromDate": "2026-05-06",
    })
    kinds = F.when(n % 5 == 0, F.lit('"employmentType":["Teilzeit",{"label":"Festanstellung"}],')).otherwise("")
    item = F.concat(F.lit('{"labels":[{"type":"x","label":"Schnelle Bewerbung"},{"name":"Top"}],"skills":["SQL",["GIS","sql"]],'), kinds, F.substring(body, F.lit(2), F.length(body)))
    rows = providers.normalise(spread(t(s, d, "supplier")).select(item.alias("json")), "stepstone")
    return rows.select("job_id", "title", "company", "location", "job_type", "salary", "work_mode", F.array_join("skills", "|").alias("skills"), F.array_join("tags", "|").alias("tags"), "posted", "job_url", "apply_url", "company_url", "description", "company_details", "metadata")


@query("""WITH p AS (SELECT *, c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'Hybrid' WHEN 1 THEN 'Remote' WHEN 2 THEN 'on demand' END AS mode, CASE WHEN c_custkey % 4 = 0 THEN 'Hybrid work' ELSE 'Flexible' END AS fact,
  CASE WHEN c_custkey % 2 = 0 THEN 'Paid listing, ' ELSE '' END || 'Top job' AS flags FROM customer)
SELECT CASE k % 2 WHEN 0 THEN k || '.abc' ELSE CAST(k AS VARCHAR) END AS job_id, c_name AS title, c_mktsegment AS company, CASE WHEN k % 3 = 0 THEN 'Berlin, Germany' ELSE 'Berlin, Mitte, Germany' END AS location, 'Full-time' AS job_type, mode AS work_mode,
  'a|b' AS skills, fact AS tags, '2026-05-06' AS posted, 'https://www.xing.com/jobs/x-' || k AS job_url, 'https://www.xing.com/companies/' || c_nationkey AS company_url,
  'Do it now' || chr(10) || chr(10) || concat_ws(chr(10), 'Xing structured metadata:', '- Salary: 50k', '- Work mode: ' || mode, '- Discipline: IT', '- Company size: 51-200', '- Language: de', '- Keywords: a, b', '- Matching facts: ' || fact, '- Listing flags: ' || flags, CASE WHEN k % 5 = 0 THEN '- Detail error: late' END) AS description,
  '{"name":"' || c_mktsegment || '","size":"51-200","city":"Berlin","url":"/companies/' || c_nationkey || '"}' AS company_details,
  '{"salary":"50k",' || coalesce('"work_mode":"' || mode || '",', '') || '"discipline":"IT","keywords":["a","b"],"matching_facts":["' || fact || '"],"company_size":"51-200","language":"de","company_public_profile":"/companies/' || c_nationkey || '"' ||
    CASE WHEN k % 2 = 0 THEN ',"paid":true' ELSE '' END || ',"top_job":true' || CASE WHEN k % 5 = 0 THEN ',"detail_error":"late"' ELSE '' END || '}' AS metadata
FROM p""")
def q58_xing_items(s, d):
    n, key = F.col("c_custkey"), F.col("c_custkey").cast("string")
    fact = F.when(n % 4 == 0, F.to_json(F.struct(F.lit("x").alias("value"), F.lit("Hybrid work").alias("label")))).otherwise('{"title":"Flexible"}')
    body = _json({
        "job_id": F.when(n % 2 == 0, F.concat(key, F.lit(".abc"))), "url": F.concat(F.lit("/jobs/x-"), key), "title": F.col("c_name"), "company": F.col("c_mktsegment"), "location": "Berlin", "location_region": F.when(n % 3 == 0, F.lit("BERLIN")).otherwise("Mitte"), "location_country": "Germany",
        "remote": _cases(n % 4, None, "Home Office", "on demand"), "keywords": F.array(F.lit("a"), F.lit("A"), F.lit("b")), "company_size": "51-200", "company_city": "Berlin", "language": "de", "discipline": "IT", "salary": "50k", "paid": n % 2 == 0, "top_job": F.lit(1), "redirects_to_third_party": F.lit(False),
        "description_html": "<p>Do <b>it</b> now</p>", "activated_at": "2026-05-06", "employment_type": "Full-time", "company_public_profile": F.concat(F.lit("/companies/"), F.col("c_nationkey").cast("string")), "detail_error": F.when(n % 5 == 0, F.lit("late")),
    })
    item = F.concat(F.lit('{"matching_facts":['), fact, F.lit("],"), F.substring(body, F.lit(2), F.length(body)))
    rows = providers.normalise(spread(t(s, d, "customer")).select(item.alias("json")), "xing")
    return rows.select("job_id", "title", "company", "location", "job_type", "work_mode", F.array_join("skills", "|").alias("skills"), F.array_join("tags", "|").alias("tags"), "posted", "job_url", "company_url", "description", "company_details", "metadata")


@query("""SELECT o_orderkey, o_orderpriority AS title, 'Co ' || o_custkey AS company, CASE o_orderkey % 4 WHEN 0 THEN 'Berlin' WHEN 1 THEN 'Bonn, NW' WHEN 2 THEN 'Road 1' ELSE 'NW, Germany' END AS location, CASE WHEN o_orderkey % 2 = 0 THEN 'Full-time' ELSE 'A, B' END AS job_type,
  CASE o_orderkey % 3 WHEN 0 THEN 'line one' || chr(10) || 'line two' WHEN 1 THEN 'within' ELSE 'a' || chr(10) || 'b' END AS description, strftime(o_orderdate, '%Y-%m-%d') AS posted, CASE WHEN o_orderkey % 4 = 1 THEN o_orderkey || 'k' END AS salary,
  CASE o_orderkey % 3 WHEN 0 THEN 'https://www.linkedin.com/jobs/view/' || o_orderkey || '/' WHEN 1 THEN 'https://a.example/' || o_orderkey ELSE 'https://de.indeed.com/v/' || o_orderkey END AS job_url, CASE o_orderkey % 3 WHEN 0 THEN CAST(o_orderkey AS VARCHAR) WHEN 1 THEN 'h' || o_orderkey END AS job_id,
  CASE WHEN o_orderkey % 2 = 0 THEN 'https://x.example/' || o_orderkey END AS apply_url, CASE o_orderkey % 4 WHEN 0 THEN 1200 WHEN 1 THEN 26 WHEN 2 THEN 7 END::BIGINT AS applicant_count, CASE o_orderkey % 4 WHEN 0 THEN '1.2k applicants' WHEN 1 THEN '25+' WHEN 2 THEN '7' END AS applicants FROM orders""")
def q59_aliases(s, d):
    """Items as they come: each field under several of its names, in several shapes; the first time that can be read counts."""
    n, key = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    co = F.concat(F.lit("Co "), F.col("o_custkey").cast("string"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    body = _json({
        "n": n, "title": F.when(n % 3 == 0, F.col("o_orderpriority")), "positionName": F.when(n % 3 == 1, F.col("o_orderpriority")), "job_title": F.col("o_orderpriority"), "companyDetails": F.when(n % 3 == 0, F.struct(co.alias("name"))), "employer": F.when(n % 3 == 1, F.struct(co.alias("name"))),
        "organization": F.when(n % 3 == 2, co), "jobType": F.when(n % 2 == 0, F.lit("Full-time")), "jobTypes": F.when(n % 2 == 1, F.array(F.lit("A"), F.lit("B"))), "postedAt": F.when(n % 2 == 0, F.lit("3 days ago")), "listedAt": day, "pubDate": "2001-01-01",
        "descriptionText": F.when(n % 3 == 0, F.lit(" line one\nline two ")), "description": F.when(n % 3 == 0, F.lit("short")), "aboutTheJob": F.when(n % 3 == 1, F.struct(F.lit("").alias("text"), F.lit("within").alias("html"))), "details": F.when(n % 3 == 2, F.array(F.lit("a"), F.lit("b"))),
        "salary_snippet": F.when(n % 4 == 1, F.concat(key, F.lit("k"))), "link": F.when(n % 3 == 1, F.concat(F.lit("https://a.example/"), key)), "viewJobLink": F.when(n % 3 == 2, F.concat(F.lit("/v/"), key)), "id": F.when(n % 3 == 0, key), "harmonisedId": F.when(n % 3 == 1, F.concat(F.lit("h"), key)), "key": F.when(n % 3 == 1, F.lit("other")),
        "externalApplyLink": F.when(n % 2 == 0, F.concat(F.lit("https://x.example/"), key)), "applicantsLabel": F.when(n % 4 == 0, F.lit("1.2k applicants")), "num_applicants": F.when(n % 4 == 1, F.lit("25+")).when(n % 4 == 2, F.lit("7")),
    })
    place = _cases(n % 4, '"location":"Berlin"', '"location":{"formatted":{"long":"Bonn, NW"}}', '"location":{"fullAddress":"Road 1"}', '"location":{"admin1Code":"NW","countryName":"Germany"}')
    rows = providers.normalise(dealt(t(s, d, "orders"), "o_orderkey").select(n, F.concat(F.lit("{"), place, F.lit(","), F.substring(body, F.lit(2), F.length(body))).alias("json")), "linkedin")
    return rows.select("o_orderkey", "title", "company", "location", "job_type", "description", "posted", "salary", "job_url", "job_id", "apply_url", "applicant_count", "applicants")


_MODES = "CASE n_nationkey % 4 WHEN 0 THEN 86400 WHEN 1 THEN 604800 WHEN 3 THEN 93600 END"
_PLAN = f"""WITH n AS (SELECT *, {_MODES} AS seconds, n_nationkey * 100 + 1 AS most, CASE n_nationkey % 4 WHEN 0 THEN '1' WHEN 1 THEN '7' WHEN 3 THEN '3' END AS days FROM nation),
u AS (SELECT *, 'https://www.linkedin.com/jobs/search/?keywords=' || replace(n_name, ' ', '+') || '&location=K%C3%B6ln+%26+more&geoId=&f_E=2%2C3&f_JT=F&position=1&pageNum=0' || coalesce('&f_TPR=r' || seconds, '') AS url FROM n),
s AS (SELECT n_nationkey AS search_idx, 'linkedin' AS source, * FROM u UNION ALL SELECT n_nationkey + 100, 'indeed', * FROM u UNION ALL SELECT n_nationkey + 200, 'stepstone', * FROM u UNION ALL SELECT n_nationkey + 300, 'xing', * FROM u) """


def _plan(s, d) -> DataFrame:
    """Each nation's name searched at each source."""
    mode = F.element_at(F.array(*map(F.lit, ["24h", "last-7d", "backfill", "since_previous_run"])), (F.col("n_nationkey") % 4 + 1).cast("int"))
    span = payloads.window(mode, F.expr("TIMESTAMP '2026-05-07 09:00:00'"), F.expr("TIMESTAMP '2026-05-06 08:00:00'"))
    named = t(s, d, "nation").select("n_nationkey", "n_name", F.posexplode(payloads.providers(F.lit("all"))).alias("place_of", "source"), span.alias("seconds"))
    levels, kinds = (F.when(F.col("source") == "linkedin", F.array(*map(F.lit, x))) for x in (["2", "3"], ["F"]))
    return named.select((F.col("n_nationkey") + F.col("place_of") * 100).cast("long").alias("search_idx"), "n_nationkey", "source", F.col("n_name").alias("keyword"), F.lit("Köln & more").alias("place"), "seconds", (F.col("n_nationkey") * 100 + 1).alias("max_items"), levels.alias("levels"), kinds.alias("kinds"))


@query(_PLAN + """SELECT search_idx, source, n_name AS keyword, CASE source WHEN 'linkedin' THEN '{"urls":["' || url || '"],"count":' || most || ',"scrapeCompany":false,"useIncognitoMode":true,"splitByLocation":false}'
 WHEN 'indeed' THEN '{"country":"de","title":"' || n_name || '","location":"Köln & more","limit":' || least(1000, most) || coalesce(',"datePosted":"' || days || '"', '') || '}'
 WHEN 'stepstone' THEN '{"maxItems":' || most || ',"maxConcurrency":10,"minConcurrency":1,"maxRequestRetries":3,"proxy":{"useApifyProxy":true},"keyword":"' || replace(lower(n_name), ' ', '-') || '","location":"k%C3%B6ln-%26-more"' || coalesce(',"postedWithin":"' || days || '"', '') || '}'
 ELSE '{"results_wanted":' || most || ',"max_pages":10,"proxyConfiguration":{"useApifyProxy":true},"keyword":"' || n_name || '","location":"Köln & more"}' END AS payload FROM s""")
def q74_scan_payloads(s, d):
    return payloads.with_payloads(_plan(s, d)).select("search_idx", "source", "keyword", "payload")


@query(_PLAN + """, b AS (SELECT *, CASE WHEN source = 'linkedin' THEN n_nationkey // 5 * 5 ELSE search_idx END AS batch FROM s)
SELECT c_custkey, CASE WHEN c_custkey % 10 > 0 THEN search_idx END AS search_idx, CASE WHEN c_custkey % 10 > 0 THEN batch END AS batch, CASE WHEN c_custkey % 10 > 0 THEN (SELECT count(*) FROM b AS o WHERE o.batch = b.batch) END AS searches
FROM customer JOIN b ON b.n_nationkey = c_nationkey AND b.source = 'linkedin'""")
def q75_batched_scans(s, d):
    """Five LinkedIn searches share a scan; customers are its items, and each goes back to the search whose address it names, some to none."""
    plan = payloads.batches(payloads.with_payloads(_plan(s, d)), 5)
    asked = plan.where("source = 'linkedin'").select("n_nationkey", "search_url")
    named = F.to_json(F.struct(F.when(F.col("c_custkey") % 10 > 0, F.col("search_url")).otherwise("ftp://nowhere").alias("inputUrl"), F.when(F.col("c_custkey") % 3 == 0, F.col("search_url")).alias("start_url"), F.col("c_name").alias("title")))
    items = t(s, d, "customer").join(asked, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.parse_json(F.when(F.col("c_custkey") % 10 == 0, F.lit('{"inputUrl":"ftp://nowhere"}')).otherwise(named)).alias("item"))
    found = scan.attributed(items.select(F.col("c_custkey").alias("id"), payloads.candidate_urls(F.col("item")).alias("candidate_urls")), plan.where("source = 'linkedin'").select("search_idx", F.col("search_url").alias("url")))
    sizes = payloads.shared_scans(plan).select("batch", F.size("urls").cast("long").alias("searches"))
    return found.join(plan.select("search_idx", "batch"), "search_idx", "left").join(sizes, "batch", "left").select(F.col("id").alias("c_custkey"), "search_idx", "batch", "searches")


@query(_PLAN + """, i AS (SELECT c_nationkey + c_custkey % 4 * 100 AS search_idx, count(*) AS n FROM customer GROUP BY 1), f AS (SELECT DISTINCT s_nationkey + s_suppkey % 4 * 100 AS search_idx FROM supplier WHERE s_acctbal < 0),
m AS (SELECT source, min(search_idx) AS failed FROM f JOIN s USING (search_idx) GROUP BY 1)
SELECT search_idx, source, CASE WHEN search_idx = failed THEN 'failed' WHEN search_idx > failed THEN 'skipped' WHEN n IS NULL THEN 'empty' ELSE 'done' END AS outcome, CASE WHEN search_idx >= failed THEN 0 ELSE coalesce(n, 0) END AS items FROM s LEFT JOIN m USING (source) LEFT JOIN i USING (search_idx)""")
def q76_scan_outcomes(s, d):
    """Customers as the items of searches, suppliers in debt as those that failed."""
    at = lambda table, nation, key: (F.col(nation) + F.col(key) % 4 * 100).cast("long").alias("search_idx")
    items = t(s, d, "customer").select(at("customer", "c_nationkey", "c_custkey"))
    return payloads.outcomes(_plan(s, d), items, t(s, d, "supplier").where("s_acctbal < 0").select(at("supplier", "s_nationkey", "s_suppkey")))


@query("""WITH e AS (SELECT user_id, CASE WHEN event_type = 'error' THEN ts END AS posted, date_trunc('hour', ts) AS run FROM events), m AS (SELECT user_id, max(posted) FILTER (posted <= TIMESTAMP '2024-01-12') AS p, max(run) FILTER (run < TIMESTAMP '2024-01-12') AS r FROM e GROUP BY 1)
SELECT user_id, coalesce(p, r) AS previous_run, CASE WHEN p IS NOT NULL THEN 'posted' WHEN r IS NOT NULL THEN 'name' END AS known_by FROM m""")
def q77_previous_run(s, d):
    """Each user's events as the runs of a spreadsheet of theirs."""
    rows = t(s, d, "events").select("user_id", F.when(F.col("event_type") == "error", F.col("ts")).alias("posted"), F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH-mm-ss").alias("run"))
    return history.run_end(rows, ["user_id"], "posted", "run", F.expr("TIMESTAMP '2024-01-12'"))


@query("""SELECT user_id::VARCHAR AS source, event_type AS keyword, ts AS posted, props AS body FROM events WHERE event_type IN ('error', 'click') AND ts > TIMESTAMP '2024-01-20 18:30:00' AND props <> '' """)
def q78_pushed_scan(s, d):
    """The event table as a remote source: types go into its request, the time bound as a window of days, and the rest stays with Spark."""
    datasource.register(s)
    s.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    items = s.read.format("scans").options(path=f"{d}/events.parquet", sourceColumn="user_id", keywordColumn="event_type", postedColumn="ts", bodyColumn="props", now="2024-01-31T00:00:00").load()
    return items.where(F.col("keyword").isin("error", "click") & (F.col("posted") > F.expr("TIMESTAMP '2024-01-20 18:30:00'")) & (F.col("body") != ""))


@query("""WITH k AS (SELECT p_partkey AS k, p_partkey % 6 AS m, p_name, p_size FROM part)
SELECT k, CASE m WHEN 0 THEN 'linkedin' WHEN 1 THEN 'indeed' WHEN 2 THEN 'stepstone' WHEN 3 THEN 'xing' WHEN 4 THEN 'other_board' ELSE 'unknown' END AS source_key,
  CASE m WHEN 0 THEN 'LinkedIn' WHEN 1 THEN 'Indeed' WHEN 2 THEN 'Stepstone' WHEN 3 THEN 'Xing' WHEN 4 THEN 'Other  Board' ELSE 'Unknown' END AS label, CASE m WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 4 END AS rank,
  CASE m WHEN 0 THEN 'koln' WHEN 1 THEN 'koln' WHEN 2 THEN 'munchen ' || p_size WHEN 3 THEN 'germany' WHEN 4 THEN 'remote' ELSE '' END AS location, CASE m WHEN 0 THEN 'fulltime' WHEN 1 THEN 'fulltime parttime' WHEN 2 THEN 'internship' WHEN 3 THEN 'contract freelance' WHEN 4 THEN 'permanent shift' ELSE '' END AS job_type,
  CASE m WHEN 0 THEN 'hybrid' WHEN 1 THEN 'remote' WHEN 2 THEN 'onsite' WHEN 3 THEN 'remote' END AS mode, 'strasse ' || p_name || ' cafe No 5 æ' AS folded, 'job title ' || p_size AS header, CASE m WHEN 5 THEN 'N/A' ELSE p_name END AS first,
  CASE WHEN p_size % 10 = 0 THEN format('{:,}', p_size * 1000) ELSE format('{:,}', p_size * 1000) || '.' || (p_size % 10) END AS money, p_name || ' | ' || p_size AS listed, lower(p_name) AS identity, CASE m WHEN 5 THEN '' ELSE p_name END AS cell, CASE m WHEN 0 THEN 1 ELSE 0 END AS plain FROM k""".replace("'Other  Board'", "'Other Board'"))
def q64_text_forms(s, d):
    """The normal forms of texts, on texts in the shapes that providers give them."""
    m, size, name = F.col("p_partkey") % 6, F.col("p_size").cast("string"), F.col("p_name")
    source = _cases(m, " Linked In ", "INDEED", "StepStone.de", "Xing  Jobs", " Other  Board ", "  ")
    place = _cases(m, "Cologne, Germany", "Köln (Home Office)", F.concat(F.lit("München "), size, F.lit(" - on-site")), "Germany", "Remote", "(work) on")
    kind = _cases(m, "Vollzeit (m/w/d)", "Full-time / Teilzeit", "Praktikum", "Contractor, freelance", "Permanent shift", "n/a")
    said = _cases(m, "Teilweise remote, hybrid", "HOMEOFFICE", "Vor Ort", "work from home", "office")
    money = F.col("p_size") * 1000 + F.when(F.col("p_size") % 10 > 0, (F.col("p_size") % 10) / 10).otherwise(0.0)
    listed = text.unique_ordered(F.array(name, F.lit(" "), F.upper("p_name"), F.concat(F.lit(" "), size), F.lit("none"), F.lit(None)))
    rows = dealt(t(s, d, "part"), "p_partkey").select(
        F.col("p_partkey").alias("k"), text.source_key(source).alias("source_key"), text.source_label(source).alias("label"), text.source_rank(text.source_key(source)).alias("rank"), text.normalize_location(place).alias("location"),
        text.normalize_job_type(kind).alias("job_type"), text.remote_mode(said).alias("mode"), text.fold(F.concat(F.lit("STRAẞE "), name, F.lit(" Café № ５ Æ"))).alias("folded"), text.normalize_header(F.concat(F.lit(" Job--Title_ "), size)).alias("header"),
        F.coalesce(text.first_of(F.lit("open job"), F.lit(" "), F.when(m != 5, F.concat(F.lit("  "), name))), F.lit("N/A")).alias("first"), text.format_money(money).alias("money"), F.array_join(listed, " | ").alias("listed"),
        text.identity_value(F.concat(F.lit(" "), F.upper("p_name"), F.lit("  "))).alias("identity"), text.clean_cell(_cases(m, name, name, name, name, F.concat(F.lit("\t"), name), "N/A")).alias("cell"), text.is_meaningful(_cases(m, name, "N/A", "none", " ", "", None)).cast("int").alias("plain"),
    )
    return rows.withColumns({"plain": F.coalesce("plain", F.lit(0))})


@query("""WITH p AS (SELECT p_partkey AS k, p_name AS a, p_name || repeat('z', p_size % 5) AS b, length(p_name) AS n, p_size % 5 AS z FROM part)
SELECT k, round(2.0 * n / (2 * n + z), 6) AS ratio, round(CASE WHEN z = 0 THEN 1.0 ELSE 1.0 / 3 END, 6) AS overlap, round(CASE WHEN z = 0 THEN 1.0 ELSE greatest(2.0 * n / (2 * n + z), 0.65 / 3 + 0.35 * 2.0 * n / (2 * n + z)) END, 6) AS blend,
  CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS seniority, CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS role, round(0.30 * 1.0 + 0.34 * 2.0 * n / (2 * n + z) + 0.18 * 0.92 + 0.10 * 0.75 + 0.08 * 0.85, 6) AS confidence FROM p""")
def q65_similarities(s, d):
    """A name against itself with letters behind it, so that the matching blocks' ratio has a closed form."""
    rows = t(s, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("a"), F.concat("p_name", F.repeat(F.lit("z"), F.col("p_size") % 5)).alias("b"))
    rows = rows.withColumn("r", similarity.sequence_ratio("a", "b")).withColumns({"x": F.split("a", " "), "y": F.split("b", " ")})
    rows = rows.withColumn("blend", similarity.blend(F.col("a"), F.col("b"), F.col("x"), F.col("y")))
    junior, senior = F.array(F.lit("junior")), F.array(F.when(F.col("k") % 3 == 0, "head").otherwise("planner"))
    role = F.array(F.when(F.col("k") % 2 == 0, "engineer").otherwise("analyst"), F.lit("data"))
    scores = {"company": F.lit(1.0), "title": F.col("r"), "location": F.lit(0.92), "job_type": F.lit(0.75), "posted_time": F.lit(0.85)}
    return rows.select(
        "k", F.round("r", 6).alias("ratio"), F.round(similarity.jaccard(F.col("x"), F.col("y")), 6).alias("overlap"), F.round("blend", 6).alias("blend"), similarity.conflicting_seniority(junior, senior).cast("int").alias("seniority"),
        similarity.conflicting_role(role, F.array(F.lit("analyst"))).cast("int").alias("role"), F.round(similarity.confidence(scores), 6).alias("confidence"),
    )


_TWINS = "WITH p AS (SELECT s_suppkey AS k, s_suppkey % 5 AS m, s_suppkey // 5 * 5 AS b FROM supplier) "


@query(_TWINS + """SELECT k AS idx, CASE m WHEN 1 THEN b WHEN 2 THEN b WHEN 4 THEN b + 3 ELSE k END AS cluster_id, CASE m WHEN 1 THEN 'apply_link' WHEN 2 THEN 'equal_profile' WHEN 4 THEN 'score' ELSE 'first' END AS stage,
  CASE m WHEN 1 THEN 0.99 WHEN 2 THEN 0.96 WHEN 4 THEN round(0.30 + 0.34 * 2.0 * 40 / 81 + 0.18 * 0.92 + 0.10 * 0.75 + 0.08 * 1.0, 6) ELSE 1.0 END AS confidence FROM p""")
def q66_clusters_by_stage(s, d):
    """Five listings of each employer: a first one, one with its apply link, one with its profile, another one, and one that is all but that one."""
    return _twins(s, d)[1].select("idx", "cluster_id", "stage", F.round("confidence", 6).alias("confidence"))


def _twins(s, d) -> tuple[DataFrame, DataFrame]:
    """Listings of five to an employer, and their clusters. Employers are told apart by words that share no letters' run."""
    k = F.col("s_suppkey")
    m, block = k % 5, F.floor(k / 5)
    digits = F.lpad(block.cast("string"), 8, "0")
    employer = F.concat(F.lit("Firm "), F.translate(digits, "0123456789", "abcdefghij"), F.lit(" GmbH"))
    word = F.translate(digits, "0123456789", "klmnopqrst")
    title = _cases(m, F.concat(F.lit("Data Engineer "), word), F.concat(F.lit("Data Engineer (m/w/d) "), word), F.concat(F.lit("Data engineer "), word, F.lit(" (Remote)")), F.concat(F.lit("Accountant for Special Payments "), word), F.concat(F.lit("Accountants for Special Payments "), word))
    link = F.concat(F.lit("https://apply.example/"), block.cast("string"))
    rows = dealt(t(s, d, "supplier"), "s_suppkey").select(
        k.alias("idx"), title.alias("title"), employer.alias("company"), _cases(m, "Berlin", "Berlin, Germany", "Berlin", "Bonn", "Bonn Mitte").alias("location"), _cases(m, "Full-time", "Vollzeit", "full time", None, "Full-time").alias("job_type"),
        _cases(m, "2026-05-01", "2026-05-02", "2026-05-03", "2026-05-01", "2026-05-02").alias("posted"), F.when(m == 0, link).when(m == 1, F.concat(link, F.lit("?utm_source=x"))).when(m == 2, F.concat(F.lit("https://www.xing.com/jobs/x-"), k.cast("string"))).alias("apply_url"),
        _cases(m, "linkedin", "indeed", "xing", "stepstone", "indeed").alias("source"), F.concat(F.lit("J"), k.cast("string")).alias("job_id"), F.concat(F.lit("https://jobs.example/"), k.cast("string")).alias("job_url"), _cases(m, "short", "a longer text", "mid text", "x", None).alias("description"),
        _cases(m, None, "50k EUR", "EUR 40000 - 60000", None, None).alias("salary"), _cases(m, "GIS", "Data", "gis", "Pay", "Pay").alias("keyword"), _cases(m, '{"name":"Firm","size":"5"}', '{"name":"Firm GmbH","tags":["a"],"more":{"x":"1"}}', '{"tags":["A","b"],"more":{"x":"2","y":"n/a"},"flag":true,"rank":7}', None, None).alias("company_details"),
    )
    rows = rows.withColumn("source_label", text.source_label(F.col("source")))
    feats = resolve.features(rows)
    return feats, resolve.clusters(feats)


@query(_TWINS + """SELECT k AS cluster_id, CASE m WHEN 0 THEN 3 ELSE 2 END AS input_rows, CASE m WHEN 0 THEN 'Data engineer ' ELSE 'Accountants for Special Payments ' END || translate(lpad(CAST(k // 5 AS VARCHAR), 8, '0'), '0123456789', 'klmnopqrst') || CASE m WHEN 0 THEN ' (Remote)' ELSE '' END AS title,
  CASE m WHEN 0 THEN 'Berlin, Germany' ELSE 'Bonn Mitte' END AS location, CASE m WHEN 0 THEN 'full time' ELSE 'Full-time' END AS job_type, CASE m WHEN 0 THEN 'a longer text' ELSE 'x' END AS description, CASE m WHEN 0 THEN '2026-05-03' ELSE '2026-05-02' END AS posted,
  CASE m WHEN 0 THEN 'EUR 40000 - 60000' END AS salary, CASE m WHEN 0 THEN 60000.0 END AS most, CASE m WHEN 0 THEN 'GIS, Data' ELSE 'Pay' END AS keywords, CASE m WHEN 0 THEN 'LinkedIn | Indeed | Xing' ELSE 'Indeed | Stepstone' END AS app, CASE m WHEN 0 THEN 'linkedin|indeed|xing' ELSE 'indeed|stepstone' END AS sources,
  CASE m WHEN 0 THEN 'https://jobs.example/' || k ELSE 'https://jobs.example/' || (k + 1) END AS job_url, CASE m WHEN 0 THEN 'https://apply.example/' || (k // 5) END AS apply_url, CASE m WHEN 0 THEN 'J' || k || ' J' || (k + 1) || ' J' || (k + 2) ELSE 'J' || (k + 1) || ' J' || k END AS ids,
  CASE m WHEN 0 THEN '{"name": "Firm", "size": "5", "tags": ["a", "b"], "more": {"x": "1"}, "rank": 7}' END AS company_details FROM p WHERE m IN (0, 3)""")
def q67_merged_clusters(s, d):
    feats, clusters = _twins(s, d)
    out = merge.merge(feats.join(clusters.select("idx", "cluster_id"), "idx"))
    ids = F.array_join(F.transform("provenance", lambda p: p["job_id"]), " ")
    return out.select("cluster_id", "input_rows", "title", "location", "job_type", "description", "posted", "salary", F.col("salary_range.maximum").alias("most"), F.array_join("keywords", ", ").alias("keywords"), "app", "sources", "job_url", "apply_url", ids.alias("ids"), "company_details")


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'linkedin:' || page_id WHEN 1 THEN 'indeed:a' || page_id WHEN 2 THEN 'stepstone:' || page_id ELSE 'www.xing.com/jobs/x-' || page_id END AS older, CASE page_id % 4 WHEN 1 THEN 'a' ELSE '' END || CASE WHEN page_id % 4 < 3 THEN CAST(page_id AS VARCHAR) END AS job_id,
  CASE WHEN page_id % 5 = 0 THEN '//ats.example/a%20b/' || page_id || '?q=x+y' END AS apply_key, CASE page_id % 4 WHEN 0 THEN 'https://www.linkedin.com/x' WHEN 1 THEN 'https://www.xing.com/x' WHEN 2 THEN 'https://cdn.example/x' END AS whole FROM pages""")
def q68_url_keys(s, d):
    n = F.col("page_id").cast("string")
    k = F.col("page_id") % 4
    link = _cases(k, F.concat(F.lit("https://www.linkedin.com/jobs/view/"), n, F.lit("/?trk=x")), F.concat(F.lit("https://de.indeed.com/viewjob?from=serp&jk=A"), n), F.concat(F.lit("https://www.stepstone.de/stellenangebote--X--"), n, F.lit("-inline.html")), F.concat(F.lit("https://www.xing.com/jobs/x-"), n, F.lit("/")))
    apply = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("https://ATS.example//a b/"), n, F.lit("/?utm_x=1&Q=x%20y&src=z"))).otherwise(link)
    whole = F.when(k == 0, urls.absolute(F.lit("/x"), "https://www.linkedin.com/")).when(k == 1, urls.absolute(F.lit("x"), "https://www.xing.com")).when(k == 2, urls.absolute(F.lit("//cdn.example/x"), "https://a.b"))
    return t(s, d, "pages").select("page_id", urls.older_key(link).alias("older"), urls.job_id_from_url(link).alias("job_id"), urls.external_apply_key(apply).alias("apply_key"), whole.alias("whole"))


@query("""WITH r AS (SELECT *, row_number() OVER (ORDER BY s_suppkey) + 1 AS n FROM supplier), k AS (SELECT s_suppkey, n, s_name FROM r)
SELECT key FROM (SELECT unnest(['apply|//a.example/' || s_suppkey, 'profile|any|' || s_suppkey || '|' || lower(s_name) || '|berlin||2026-05-01', 'profile|xing|' || lower(s_name) || '|co ' || s_suppkey || ' gmbh|berlin||2026-05-01']) AS key FROM k)
UNION SELECT unnest(['profile|indeed|t|c|l', 'profile|any|c|t|l||'])""")
def q69_history_of_tabs(s, d):
    """All suppliers as the rows of an old worksheet, whose keys seed the index; then the index with an older key in it."""
    key = F.col("s_suppkey").cast("string")
    rows = t(s, d, "supplier").select(
        F.lit("Xing").alias("App"), F.col("s_name").alias("Job Title"), F.concat(F.lit("Co "), key, F.lit(" GmbH")).alias("Company"), F.lit("Berlin").alias("Location"), F.lit("2026-05-01 08:00:00").alias("Posted"),
        F.concat(F.lit('=HYPERLINK("https://a.example/'), key, F.lit('?ref=1", "Open Apply")')).alias("Apply URL"),
    )
    older = s.createDataFrame([("profile|indeed|t|c|l",)], "key string")
    return history.index_keys(history.tab_keys(rows).union(older))


@query("""SELECT s_suppkey + 2 AS row_number, s_name AS title, CASE WHEN s_suppkey % 3 = 0 THEN 'Suitable' WHEN s_suppkey % 3 = 1 THEN 'Not Suitable' ELSE '' END AS verdict, CASE WHEN s_suppkey % 3 < 2 THEN CAST(s_suppkey % 20 AS VARCHAR) ELSE '' END AS score FROM supplier WHERE s_suppkey % 3 <> 1 OR s_suppkey % 2 = 0""")
def q71_evaluations_written_back(s, d):
    """Suppliers as a worksheet: evaluations are upserted by row, rejected rows (but those with one label) and columns that are done with go."""
    key = F.col("s_suppkey")
    rows = evaluate.with_output_columns(t(s, d, "supplier").select((key + 2).alias("row_number"), F.col("s_name").alias("Job Title"), F.lit("d").alias("Details"), F.lit("").alias("AI Verdict"), F.lit("r").alias("AI Reason")))
    kind = key % 3
    new = t(s, d, "supplier").where(kind < 2).select((key + 2).alias("row_number"), F.when(kind == 0, "Suitable").otherwise("Not Suitable").alias("AI Verdict"), (key % 20).cast("string").alias("AI Fit Score"), F.when(kind == 0, "").when(key % 2 == 0, "far").otherwise("far; wide").alias("AI Unsuitable Reasons"))
    done = evaluate.upsert(rows, new, "row_number", ["AI Verdict", "AI Fit Score", "AI Unsuitable Reasons"])
    left = evaluate.without_rejected(done, "`AI Verdict`", "`AI Unsuitable Reasons`").drop(*evaluate.dropped_columns(done.columns))
    return left.select("row_number", F.col("Job Title").alias("title"), F.col("AI Verdict").alias("verdict"), F.col("AI Fit Score").alias("score"))


@query(r"""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS is_cv, CASE p_partkey % 3 WHEN 0 THEN '\input' WHEN 1 THEN '\write18' ELSE '' END AS unsafe, p_size AS pages, 'failed: ' || p_name AS cell, p_name AS fenced, CASE WHEN p_partkey % 2 = 0 THEN '\documentclass{a}' || p_name ELSE '' END AS cv,
  '\documentclass{a}' || chr(10) || '\usepackage{fontspec}' || chr(10) || '\defaultfontfeatures{Ligatures=TeX}' || chr(10) || '\setmainfont{lmroman10-regular.otf}[' || chr(10) || '  BoldFont=lmroman10-bold.otf,' || chr(10) || '  ItalicFont=lmroman10-italic.otf,' || chr(10) || '  BoldItalicFont=lmroman10-bolditalic.otf' || chr(10) || ']' || chr(10) || p_name AS fonts,
  p_name || ' / ' || p_brand AS display, 'master' || chr(10) || chr(10) || '# Job advertisement' || chr(10) || chr(10) || p_name || chr(10) || chr(10) || '# Master CV (LaTeX)' || chr(10) || chr(10) || 'cv' AS prompt FROM part""")
def q72_documents(s, d):
    name = F.col("p_name")
    k = F.col("p_partkey")
    source = F.concat(F.lit("\\documentclass{a}\n"), name)
    body = F.when(k % 2 == 0, F.concat(F.lit("\\documentclass{a}"), name)).otherwise(F.concat(F.lit("not a cv "), name))
    response = F.concat(F.lit("Verdict: Suitable\nCustomized CV (LaTeX):\n```latex\n"), body, F.lit("\n```\n"))
    log = F.concat(F.lit("x\nOutput written on a.pdf (" ), F.col("p_size").cast("string"), F.lit(" pages, 5 bytes).\n"))
    return t(s, d, "part").select(
        "p_partkey", latex.looks_like_cv(body).cast("int").alias("is_cv"), latex.unsafe_command(_cases(k % 3, "a \\input{x} \\write18", "\\write18{ls}", "\\inputs \\textbf{x}")).alias("unsafe"), latex.page_count(log).alias("pages"), latex.error_cell("failed", F.concat(F.lit(" "), name)).alias("cell"),
        latex.fenced(F.concat(F.lit("x ```latex\n "), name, F.lit("\n``` y ```z```"))).alias("fenced"), evaluate.cv_of_response(response).alias("cv"), latex.with_fonts(F.concat(F.lit("\\documentclass{a}\n\\usepackage[utf8]{inputenc} % x\n"), name)).alias("fonts"),
        evaluate.display_name(F.concat(F.lit(" "), name), F.col("p_brand"), k).alias("display"), evaluate.prompt("master ", name, " cv").alias("prompt"),
    )


@query("""SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'linkedin xing' WHEN 1 THEN 'linkedin' ELSE 'linkedin indeed stepstone xing' END AS sources, CASE n_nationkey % 4 WHEN 0 THEN 86400 WHEN 1 THEN 604800 WHEN 3 THEN 93600 END AS seconds, CASE n_nationkey % 4 WHEN 0 THEN '1' WHEN 1 THEN '7' WHEN 3 THEN '3' ELSE '' END AS days,
  least(1000, greatest(1, n_nationkey * 100)) AS lim, 'a-' || lower(n_name) || '%2Fx' AS slug FROM nation""")
def q73_scan_windows(s, d):
    """Sources, windows and limits of a scan, as the payloads take them from configuration."""
    k = F.col("n_nationkey")
    said = _cases(k % 3, "xing jobs, linked in", "?", "all")
    mode = _cases(k % 4, "24h", "last-7d", "backfill", "since_previous_run")
    span = payloads.window(mode, F.expr("TIMESTAMP '2026-05-07 09:00:00'"), F.expr("TIMESTAMP '2026-05-06 08:00:00'"))
    plan = t(s, d, "nation").select("n_nationkey", F.lit("indeed").alias("source"), F.col("n_name").alias("keyword"), F.lit("").alias("place"), span.alias("seconds"), (k * 100).alias("max_items"), F.array_join(payloads.providers(said), " ").alias("sources"))
    made, at = payloads.with_payloads(plan), lambda f: F.get_json_object("payload", "$." + f)
    return made.select("n_nationkey", "sources", "seconds", F.coalesce(at("datePosted"), F.lit("")).alias("days"), at("limit").cast("int").alias("lim"), payloads.slug(F.concat(F.lit(" A "), "keyword", F.lit("/x"))).alias("slug"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def q79_remembered_keys(s, d):
    """The event table as a stream against keyed state, whose keys expire a year after they came last."""
    from .session import fresh_path
    from .streaming import incremental

    incremental.use_rocksdb(s)
    rows = s.readStream.schema(t(s, d, "events").schema).parquet(f"{d}/events.parq*").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    at = fresh_path(s, "remembered")
    fresh = incremental.remembered(rows, ["user_id", "event_type"], "ts", 365 * 86_400, late="60 days", renew=True)
    fresh.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(fresh.schema).parquet(f"{at}/out").select("user_id", "event_type")
