"""Raw items of four providers to one listing row.

A raw item is JSON of any shape in a VARIANT column; a projection is a select of
variant_get, so an absent field is NULL and a malformed item gives no row. What a
provider tells about the company and the listing beside the common columns is kept as
JSON objects in ``company_details`` and ``metadata``, of the fields that say something.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import dates, numbers, text, urls

TEXT = "string"
TEXTS = "array<string>"
PREFERRED = ["label", "name", "title", "value", "text"]


def parsed(df: DataFrame, column: str = "json") -> DataFrame:
    """The columns `json`, `raw` and `_fields` (its fields by name) of objects; what isn't a JSON object is dropped."""
    out = df.withColumns({"json": F.col(column), "raw": F.try_parse_json(column)})
    return out.withColumn("_fields", F.try_variant_get("raw", "$", "map<string,variant>")).where(F.col("_fields").isNotNull())


def variant(path: str, raw: str = "raw") -> Column:
    return F.try_variant_get(F.col(raw), "$." + path, "variant")


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _scalar(v: Column) -> Column:
    return _scalar_at(v, "$")


def _scalar_at(v: Column, path: str) -> Column:
    """Text of a scalar at a path; NULL for booleans, objects and arrays. Only what reads like one of these is asked for its kind."""
    kind = _kind(v if path == "$" else F.try_variant_get(v, path, "variant"))
    other = lambda s: F.substring(s, 1, 1).isin("{", "[") | s.isin("true", "false")
    return text.let(F.try_variant_get(v, path, TEXT), lambda s: F.when(s.isNull(), F.lit(None).cast(TEXT)).when(~other(s), s).when(~kind.rlike("^(OBJECT|ARRAY|BOOLEAN)"), s))


def untagged(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", " ")


def _filled(c: Column) -> Column:
    return text.let(c, text.none_if_blank)


def field(path: str, html: bool = False) -> Column:
    """A scalar as trimmed text, without its tags if html; NULL for booleans, objects, arrays and blanks."""
    said = _scalar_at(F.col("raw"), "$." + path)
    return _filled(text.normalize_space(untagged(said) if html else said))


def first_field(*paths: str, html: bool = False) -> Column:
    return F.coalesce(*(field(p, html) for p in paths))


def named(keys: list[str], fields: Column | None = None) -> Column:
    """The values of those top-level fields that are there, in the order of keys. One expression, however many keys."""
    return text.let(F.col("_fields") if fields is None else fields, lambda m: F.array_compact(F.transform(text.words(keys), lambda k: F.try_element_at(m, k))))


def first(array: Column) -> Column:
    return F.get(F.filter(array, lambda x: x.isNotNull()), 0)


def first_meaningful(paths: list[str]) -> Column:
    """The first that says anything; paths of more than one step come one by one."""
    parts: list[list[str]] = []
    for p in paths:
        if parts and "." not in p and "." not in parts[-1][0]:
            parts[-1].append(p)
        else:
            parts.append([p])
    clean = lambda v: text.meaningful(text.normalize_space(_scalar(v)))
    return F.coalesce(*(text.meaningful(field(g[0])) if "." in g[0] else first(F.transform(named(g), clean)) for g in parts))


#: A scalar of a JSON text, or a name with its colon, which no scalar ends with.
_SCALARS = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\s*:)?|-?[0-9][-+.0-9eE]*|true|false|null'


def scalars(raw: Column) -> Column:
    """Texts of the strings and numbers of a JSON text in its order, however deep they stand. One pass, whatever the shape."""
    found = F.filter(F.regexp_extract_all(raw, F.lit(_SCALARS), F.lit(0)), lambda x: ~F.endswith(x, F.lit(":")) & ~x.isin("true", "false", "null"))
    plain = lambda x: F.when(F.contains(x, F.lit("\\")), F.get_json_object(F.concat(F.lit("["), x, F.lit("]")), "$[0]")).otherwise(F.substring(x, F.lit(2), F.length(x) - 2))
    return F.transform(found, lambda x: F.when(F.startswith(x, F.lit('"')), plain(x)).otherwise(x))


def all_values(path: str) -> Column:
    """As values() without preferred names, at any depth."""
    top = variant(path)
    deep = text.let(F.get_json_object("json", "$." + path), scalars)
    found = F.when(top.isNull(), F.lit(None)).when(_kind(top).rlike("^(OBJECT|ARRAY)"), deep).otherwise(F.array(_scalar(top)))
    clean = F.transform(F.filter(found, lambda x: x.isNotNull() & ~x.isin("", "N/A")), text.normalize_space)
    return F.coalesce(F.filter(clean, lambda x: x != ""), F.array().cast(TEXTS))


def values(path: str, prefer: list[str] = (), html: bool = False) -> Column:
    """All texts of a scalar, a list or an object, three deep, in order. An object counts by the first of `prefer` that says something, if any."""

    def inner(v: Column) -> Column:
        fields = F.try_variant_get(v, "$", "map<string,variant>")
        named = F.coalesce(*(F.when(F.coalesce(F.try_variant_get(v, f"$.{k}", TEXT), F.lit("x")) != "", F.try_variant_get(v, f"$.{k}", "variant")) for k in prefer)) if prefer else F.lit(None).cast("variant")
        return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.when(named.isNotNull(), F.array(named)), F.map_values(fields), F.array(v))

    top = variant(path)
    # an object's own order is that of its text; VARIANT sorts fields by name
    fields = F.when(_kind(top).startswith("OBJECT"), F.map_values(F.from_json(F.get_json_object("json", "$." + path), "map<string,variant>")))
    named = F.coalesce(*(F.when(F.coalesce(F.try_variant_get(top, f"$.{k}", TEXT), F.lit("x")) != "", F.try_variant_get(top, f"$.{k}", "variant")) for k in prefer)) if prefer else F.lit(None).cast("variant")
    found = F.coalesce(F.when(named.isNotNull(), F.array(named)), fields, F.try_variant_get(top, "$", "array<variant>"), F.array(top))
    for _ in range(2):
        found = F.flatten(F.transform(found, inner))
    said = F.filter(F.transform(F.filter(found, lambda v: v.isNotNull()), _scalar), lambda x: x.isNotNull() & ~x.isin("", "N/A"))
    clean = F.transform(said, lambda x: text.normalize_space(untagged(x) if html else x))
    return F.coalesce(F.filter(clean, lambda x: x != ""), F.array().cast(TEXTS))


def unique(array: Column, limit: int | None = None) -> Column:
    """In order of first appearance; case doesn't tell values apart."""
    pairs = F.transform(array, lambda x: F.struct(x.alias("x"), F.lower(x).alias("low")))
    kept = text.let(pairs, lambda p: F.transform(F.filter(p, lambda x, i: F.array_position(p["low"], x["low"]) == i + 1), lambda x: x["x"]))
    return F.slice(kept, 1, limit) if limit else kept


def listed(array: Column) -> Column:
    return text.none_if_blank(F.array_join(array, ", "))


def flag(path: str) -> Column:
    """Whether a field says yes: true, a number but 0, any text; NULL otherwise, so that an object lacks it."""
    v = variant(path)
    number = F.try_variant_get(v, "$", "double")
    said = F.when(_kind(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean")).when(_kind(v) == "STRING", F.try_variant_get(v, "$", TEXT) != "").otherwise(number != 0)
    return F.when(said, F.lit(True))


def raw_field(path: str) -> Column:
    """A field as it stands; NULL for null, blanks, and empty objects and lists."""
    v = variant(path)
    return F.when(~F.coalesce(F.try_variant_get(v, "$", TEXT), F.lit("")).isin("", "{}", "[]"), v)


def json_object(fields: dict[str, Column]) -> Column:
    """JSON of the fields that say something; NULL if none does."""
    said = F.to_json(F.struct(*(c.alias(k) for k, c in fields.items())))
    return F.when(said != "{}", said)


def some(array: Column) -> Column:
    return F.when(F.size(array) > 0, array)


def tag_is(tag: Column, words: list[str]) -> Column:
    return text.any_in(F.lower(tag), words)


def is_experience(tag: Column) -> Column:
    return F.lower(tag).rlike(r"\d+\+?\s+years?|experience")


def is_skill(tag: Column) -> Column:
    low = F.lower(tag)
    return low.isin(fixed.LANGUAGES) | F.endswith(low, F.lit(" skills")) | text.any_in(low, fixed.SKILL_WORDS)


def is_seniority(tag: Column) -> Column:
    return F.contains(F.lower(tag), F.lit("level")) & tag_is(tag, fixed.SENIORITY_WORDS)


def work_mode(said: Column, else_: Column, onsite: list[str] = fixed.ONSITE_WORDS) -> Column:
    """Hybrid before Remote before else_ before On-site."""
    low = F.lower(said)
    early = F.when(text.any_in(low, fixed.HYBRID_WORDS), "Hybrid").when(text.any_in(low, fixed.ITEM_REMOTE_WORDS), "Remote")
    return F.coalesce(early, else_, F.when(text.any_in(low, onsite), "On-site"))


def money_range(low: Column, high: Column, currency: Column, unit: Column) -> Column:
    amount = F.when(low.isNotNull() & high.isNotNull() & (low != high), F.concat(text.format_money(low), F.lit("-"), text.format_money(high))).otherwise(text.format_money(F.coalesce(low, high)))
    return F.when(amount.isNotNull(), F.concat(F.coalesce(F.concat(currency, F.lit(" ")), F.lit("")), amount, F.coalesce(F.concat(F.lit(" / "), unit), F.lit(""))))


def number(path: str) -> Column:
    n = F.replace(field(path), F.lit(","), F.lit("")).try_cast("double")
    return F.when(n >= 0, n)


def with_lines(description: Column, source: str, lines: list[tuple[str, Column]]) -> Column:
    """A description, then a block of labelled lines; empty ones are left out."""
    said = F.array_compact(F.array(*(F.when(c != "", F.concat(F.lit(f"- {name}: "), c)) for name, c in lines)))
    block = text.let(said, lambda s: F.when(F.size(s) > 0, F.concat(F.lit(f"{source} structured metadata:\n"), F.array_join(s, "\n"))))
    return text.none_if_blank(F.concat_ws("\n\n", text.none_if_blank(description), block))


def applicants() -> Column:
    """The first meaningful value as text; lists and objects as JSON."""
    said = lambda v: text.meaningful(text.normalize_space(F.when(_kind(v) != "BOOLEAN", F.try_variant_get(v, "$", TEXT))))
    return first(F.transform(named(fixed.APPLICANT_KEYS), said))


def applicant_count() -> Column:
    """The count of the first key that has one. Of a list or an object, the largest in it, down to three lists or objects in one another."""
    known = text.words([*fixed.APPLICANT_KEYS, "count", "value", "text", "label"])

    def items(v: Column) -> Column:
        fields = F.map_values(F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, _: F.array_contains(known, k)))
        return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), fields, F.array(v))

    def count(v: Column) -> Column:
        kind, n = _kind(v), F.try_variant_get(v, "$", "double")
        return F.when(kind == "STRING", numbers.applicant_count(F.try_variant_get(v, "$", TEXT))).when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & (n >= 0), n.cast("long"))

    def largest(v: Column) -> Column:
        inner = items(v)
        for _ in range(2):
            inner = F.flatten(F.transform(inner, items))
        return F.array_max(F.transform(inner, count))

    return first(F.transform(named(fixed.APPLICANT_KEYS), largest))


LISTING = ["source", "source_label", "job_id", "title", "company", "company_url", "location", "job_type", "description", "posted", "salary", "work_mode", "skills", "tags", "job_url", "apply_url", "applicants", "applicant_count", "company_details", "metadata"]


def _row(source: str, **columns: Column) -> list[Column]:
    columns = {"source": F.lit(source), "source_label": F.lit(fixed.SOURCE_LABELS[source]), "applicants": applicants(), "applicant_count": applicant_count()} | columns
    none = {"skills": F.array().cast(TEXTS), "tags": F.array().cast(TEXTS)}
    return [(columns[c] if c in columns else none.get(c, F.lit(None).cast("string"))).alias(c) for c in LISTING]


def _indeed_salary(path: str) -> Column:
    """A range with its unit, else the field's texts."""
    return F.coalesce(money_range(number(f"{path}.minValue"), number(f"{path}.maxValue"), field(f"{path}.currencyCode"), F.lower(field(f"{path}.unitOfWork"))), listed(unique(all_values(path))))


def indeed(df: DataFrame) -> DataFrame:
    lists = {"attributes": 40, "benefits": 12, "jobTypes": 8, "employerAttributes": 12}
    df = df.withColumns({f"_{c}": unique(all_values(c)) for c in lists})
    kinds = F.coalesce(listed(F.col("_jobTypes")), listed(F.filter("_employerAttributes", lambda x: tag_is(x, fixed.TAG_JOB_TYPES))))
    df = df.withColumns({"_tags": unique(F.concat(*(F.slice(f"_{c}", 1, n) for c, n in lists.items()))), "_kinds": kinds, "_benefits": F.slice("_benefits", 1, lists["benefits"])})
    parts = F.array_compact(F.array(field("location.city"), field("location.admin1Code"), first_field("location.countryName", "location.countryCode")))
    place = F.coalesce(listed(unique(parts)), first_field("location.streetAddress", "location.formatted", "location.name", "location"))
    df = df.withColumns({"_place": place, "_salary": F.coalesce(*map(_indeed_salary, ("baseSalary", "salary", "salaryText"))), "_seniority": F.get(F.filter("_tags", is_seniority), 0)})
    t = F.col("_tags")
    fine = lambda x: is_skill(x) & ~tag_is(x, fixed.BENEFIT_WORDS) & ~tag_is(x, fixed.TAG_JOB_TYPES) & ~tag_is(x, fixed.EDUCATION_WORDS) & ~is_experience(x) & (F.coalesce(F.col("_seniority"), F.lit("")) != x)
    low = F.lower(F.concat_ws(" ", "_place", F.array_join("_tags", " ")))
    mode = F.when(F.contains(low, F.lit("hybrid")), "Hybrid").when(low.rlike("remote|work from home"), "Remote").when(low.rlike("on-site|on site|in-person"), "On-site")
    df = df.withColumns({"_skills": F.slice(F.filter(t, fine), 1, 12), "_mode": mode, "_education": F.slice(F.filter(t, lambda x: tag_is(x, fixed.EDUCATION_WORDS)), 1, 5), "_experience": F.slice(F.filter(t, is_experience), 1, 5)})
    df = df.withColumn("_languages", F.slice(F.filter("_skills", lambda x: F.lower(x).isin(fixed.LANGUAGES)), 1, 6))
    rating = F.concat(field("employer.ratingsValue"), F.coalesce(F.concat(F.lit(" ("), field("employer.ratingsCount"), F.lit(" reviews)")), F.lit("")))
    size, industry = field("employer.employeesCount"), field("employer.industry")
    joined = lambda c: F.array_join(c, ", ")
    lines = [
        ("Salary", F.col("_salary")), ("Work mode", F.col("_mode")), ("Seniority", F.col("_seniority")), ("Employer rating", rating), ("Company size", size), ("Industry", industry),
        ("Skills", joined("_skills")), ("Programming languages", joined("_languages")), ("Experience", joined("_experience")), ("Education", joined("_education")), ("Benefits", joined("_benefits")),
    ]
    metadata = json_object({
        "salary": F.col("_salary"), "benefits": some(F.col("_benefits")), "skills": some(F.col("_skills")), "programming_languages": some(F.col("_languages")), "remote_work": F.col("_mode"), "seniority": F.col("_seniority"),
        "experience_requirements": some(F.col("_experience")), "education_requirements": some(F.col("_education")), "employer_rating": rating, "company_size": size, "industry": industry,
    })
    company = json_object({k: raw_field(f"employer.{k}") for k in ("name", "industry", "employeesCount", "ratingsValue", "ratingsCount", "relativeCompanyPageUrl")})
    key = F.coalesce(first_field("key", "jobKey", "jobId", "job_id", "id"), *(text.none_if_blank(F.trim(F.regexp_extract(field(u), r"[?&]jk=([^&#]+)", 1))) for u in ("url", "jobUrl", "link")))
    return df.select(*_keep(df), *_row(
        "indeed", job_id=key, title=first_field("title", "name"), company=first_field("employer.name", "companyName"), company_url=first_field("employer.url"), location=F.col("_place"), job_type=F.col("_kinds"),
        description=with_lines(first_field("description.text", "description", "summary", "snippet"), "Indeed", lines), posted=first_field("datePublished", "dateOnIndeed", "postedAt"), salary=F.col("_salary"), work_mode=F.col("_mode"),
        skills=F.col("_skills"), tags=t, job_url=first_field("url", "link"), apply_url=first_field("jobUrl", "applyUrl"), company_details=company, metadata=metadata,
    ))


STEPSTONE, XING = "https://www.stepstone.de", "https://www.xing.com"


def stepstone(df: DataFrame) -> DataFrame:
    get = lambda *p: first_field(*p, html=True)
    many = lambda path: values(path, ["label", "name", "value"], html=True)
    link = lambda *p: urls.absolute(get(*p), STEPSTONE)
    df = df.withColumns({
        "_plain_labels": many("labels"), "_labels": unique(F.concat(many("labels"), many("topLabels")), 12), "_skills": unique(many("skills"), 16), "_company_url": link("companyUrl"),
        "_body": text.normalize_space(text.html_unescape(untagged(_first_text("description", "jobDescription", "details", "textSnippet", "summary")))),
    })
    said = F.lower(F.concat_ws(" ", get("title"), get("textSnippet"), F.array_join("_plain_labels", " ")))
    explicit = unique(F.concat(*map(many, ("employmentType", "jobType", "jobTypes", "contractType"))))
    df = df.withColumns({"_said": said, "_explicit": explicit})
    heard = F.filter(text.words(fixed.HEARD_JOB_TYPES), lambda w: F.contains(F.col("_said"), w))
    home = get("workFromHome")
    mode = work_mode(F.concat_ws(" ", home, get("location"), "_said"), F.when(~home.isin("0", "false", "False"), "Work from home available"))
    salary = F.coalesce(get("salary"), money_range(number("unifiedSalary.min"), number("unifiedSalary.max"), get("unifiedSalary.currency"), get("unifiedSalary.period")))
    df = df.withColumns({"_mode": mode, "_salary": salary, "_category": get("category", "industry", "section")})
    lines = [("Salary", F.col("_salary")), ("Work mode", F.col("_mode")), ("Skills", F.array_join("_skills", ", ")), ("Category", F.col("_category")), ("Labels", F.array_join("_labels", ", "))]
    flags = {"is_sponsored": "isSponsored", "is_highlighted": "isHighlighted", "is_top_job": "isTopJob", "is_partnership_job": "partnership.isPartnershipJob"}
    metadata = json_object({
        "salary": F.col("_salary"), "work_mode": F.col("_mode"), "labels": some(F.col("_labels")), "skills": some(F.col("_skills")), "category": F.col("_category"), "company_id": get("companyId"), "company_url": F.col("_company_url"),
    } | {k: flag(p) for k, p in flags.items()})
    company = json_object({k: raw_field(p) for k, p in {"name": "companyName", "id": "companyId", "logoUrl": "companyLogoUrl", "isAnonymous": "isAnonymous"}.items()} | {"url": F.col("_company_url")})
    return df.select(*_keep(df), *_row(
        "stepstone", job_id=get("id", "jobId", "job_id", "harmonisedId"), title=get("title", "jobTitle", "name"), company=get("companyName", "company"), company_url=F.col("_company_url"), location=get("location", "formattedLocation"),
        job_type=listed(text.or_else(F.col("_explicit"), heard)), description=with_lines(F.col("_body"), "Stepstone", lines), posted=get("datePosted", "publishFromDate", "periodPostedDate", "postedAt"), salary=F.col("_salary"), work_mode=F.col("_mode"),
        skills=F.col("_skills"), tags=F.col("_labels"), job_url=link("url", "jobUrl", "link"), apply_url=link("applyUrl", "applicationUrl", "applicationLink"), company_details=company, metadata=metadata,
    ))


def _first_text(*paths: str) -> Column:
    """The first field with text beside its tags, tags and all."""
    return F.coalesce(*(F.when(field(p, html=True).isNotNull(), _scalar(variant(p))) for p in paths))


def xing(df: DataFrame) -> DataFrame:
    many = lambda path: values(path, PREFERRED, html=True)
    link = lambda *p: urls.absolute(first_field(*p), XING)
    df = df.withColumns({
        "_all_facts": many("matching_facts"), "_facts": unique(many("matching_facts"), 12), "_keywords": unique(many("keywords"), 20),
        "_html": text.normalize_space(text.html_unescape(untagged(field("description_html")))),  # a column of its own, since lambdas can't hold Python
        "_place": listed(unique(F.array_compact(F.array(field("location"), field("location_region"), field("location_country"))))),
    })
    html = F.col("_html")
    said = F.concat_ws(" ", field("remote"), field("title"), field("location"), field("description_text"), html, F.array_join("_all_facts", " "), F.array_join(many("non_matching_facts"), " "))
    df = df.withColumn("_mode", F.coalesce(work_mode(said, F.lit(None).cast("string")), field("remote")))
    flags = {"Paid listing": ("paid", "paid"), "Top job": ("top_job", "top_job"), "Redirects to third party": ("redirects_to_third_party", "redirects_to_third_party")}
    raised = F.array_join(F.array_compact(F.array(*(F.when(flag(p), F.lit(name)) for name, (p, _) in flags.items()))), ", ")
    plain_fields = {"Discipline": "discipline", "Category": "job_category", "Company size": "company_size", "Company industry": "company_industry", "Language": "language", "Application method": "application_type", "Active until": "active_until"}
    lines = [("Salary", field("salary")), ("Work mode", F.col("_mode")), *((name, field(p)) for name, p in plain_fields.items()), ("Keywords", F.array_join("_keywords", ", ")), ("Matching facts", F.array_join("_facts", ", ")), ("Listing flags", raised), ("Detail error", field("detail_error"))]
    metadata = json_object(
        {"salary": field("salary"), "work_mode": F.col("_mode"), "discipline": field("discipline"), "job_category": field("job_category"), "keywords": some(F.col("_keywords")), "matching_facts": some(F.col("_facts"))}
        | {k: field(k) for k in ("company_size", "company_industry", "language", "application_type", "active_until", "company_public_profile")}
        | {k: flag(p) for p, k in flags.values()} | {"detail_error": field("detail_error")}
    )
    company = json_object({k: raw_field(p) for k, p in {"name": "company", "id": "company_id", "logoUrl": "company_logo", "size": "company_size", "industry": "company_industry", "city": "company_city", "country": "company_country", "url": "company_public_profile"}.items()})
    key = F.coalesce(first_field("job_id", "jobId", "id", "global_id", "globalId", "slug"), text.none_if_blank(F.regexp_extract(F.regexp_replace(field("url"), "[?#].*$", ""), urls.PROVIDER_IDS["xing.com"][1], 1)))
    return df.select(*_keep(df), *_row(
        "xing", job_id=key, title=field("title"), company=field("company"), company_url=link("company_public_profile"), location=F.col("_place"), job_type=first_field("job_type", "employment_type"),
        description=with_lines(F.coalesce(field("description_text"), html), "Xing", lines), posted=first_field("date_posted", "activated_at"), salary=field("salary"), work_mode=F.col("_mode"), skills=F.col("_keywords"), tags=F.col("_facts"),
        job_url=link("url"), apply_url=link("apply_url"), company_details=company, metadata=metadata,
    ))


def joined(v: Column) -> Column:
    """A scalar, or the parts of a list."""
    items = F.filter(F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.try_variant_get(x, "$", TEXT)), lambda x: F.trim(x) != "")
    return F.coalesce(text.meaningful(text.normalize_space(_scalar(v))), _filled(F.array_join(items, ", ")))


def _as_it_stands(v: Column) -> Column:
    return text.meaningful(text.strip(_scalar(v)))


def described(v: Column) -> Column:
    """A description as it stands, lines and all: a text, the first of an object's fields that holds one, or a list's texts by lines."""
    fields = F.try_variant_get(v, "$", "map<string,variant>")
    within = text.let(fields, lambda m: first(F.transform(named([*fixed.DESCRIPTION_KEYS, *fixed.DESCRIPTION_FIELDS], m), _as_it_stands)))
    items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.coalesce(_as_it_stands(x), _as_it_stands(F.try_variant_get(x, "$.text", "variant"))))
    return F.coalesce(_as_it_stands(v), within, _filled(F.array_join(F.array_compact(items), "\n")))


def longest_description() -> Column:
    """The longest of the fields that hold whole descriptions (the first of equals), else the first of any that describes."""
    texts = F.transform(named(fixed.LONG_DESCRIPTION_KEYS), lambda v: F.when(_kind(v) == "STRING", _as_it_stands(v)))
    ranked = F.transform(F.array_compact(F.concat(texts, F.array(first_meaningful(fixed.DESCRIPTION_KEYS)))), lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("x")))
    return F.coalesce(F.array_min(ranked)["x"], first(F.transform(named(fixed.DESCRIPTION_KEYS), described)))


def first_parseable(keys: list[str]) -> Column:
    """The first field that is a time, else the first that says anything."""
    said = F.array_compact(F.transform(named(keys), lambda v: text.meaningful(text.normalize_space(_scalar(v)))))
    return text.let(said, lambda s: F.coalesce(F.get(F.filter(s, lambda x: dates.parse_datetime(x).isNotNull()), 0), F.get(s, 0)))


def listing_url(source: str, country: str = "de") -> Column:
    """The item's own link, else one made of what it says of itself."""
    base = "https://" + fixed.INDEED_HOSTS.get(country.lower(), f"{country.lower()}.indeed.com")
    direct = first_meaningful(fixed.JOB_URL_KEYS if source == "linkedin" else fixed.PROVIDER_URL_KEYS)
    view, job_id = field("viewJobLink"), first_field(*fixed.LINK_ID_KEYS)
    made = {"indeed": F.concat(F.lit(f"{base}/viewjob?jk="), job_id), "linkedin": F.concat(F.lit("https://www.linkedin.com/jobs/view/"), job_id, F.lit("/")), "xing": F.concat(F.lit(f"{XING}/jobs/"), F.when(job_id.isNotNull(), F.coalesce(field("slug"), job_id)))}
    return F.coalesce(direct, F.when(F.startswith(view, F.lit("http")), view).otherwise(F.concat(F.lit(base), view)), made.get(source, F.lit(None).cast("string")))


def plain(df: DataFrame, source: str = "linkedin", country: str = "de") -> DataFrame:
    """Items that keep the common aliases as they come."""
    m = first_meaningful
    parts = listed(F.array_compact(F.array(*map(field, fixed.LOCATION_PARTS))))
    df = df.withColumn("_url", listing_url(source, country))
    row = _row(
        source, job_id=F.coalesce(m(fixed.JOB_ID_KEYS), urls.job_id_from_key(urls.canonical_url(F.col("_url")))), title=m(fixed.TITLE_KEYS), company=m(fixed.COMPANY_KEYS), company_url=m(fixed.COMPANY_URL_KEYS),
        location=F.coalesce(m(fixed.LOCATION_KEYS), m(fixed.LOCATION_FIELDS), parts), job_type=first(F.transform(named(fixed.JOB_TYPE_KEYS), joined)), description=longest_description(), posted=first_parseable(fixed.POSTED_KEYS),
        salary=m(fixed.SALARY_KEYS), job_url=F.col("_url"), apply_url=m(fixed.APPLY_URL_KEYS), company_details=F.when(_kind(variant("companyDetails")).startswith("OBJECT"), F.get_json_object("json", "$.companyDetails")),
    )
    return df.select(*_keep(df), *row)


def _keep(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in LISTING and not c.startswith("_")]


NORMALISERS = {"linkedin": plain, "indeed": indeed, "stepstone": stepstone, "xing": xing}


def normalise(df: DataFrame, source: str) -> DataFrame:
    """Listings of one provider from a column `json`."""
    if source not in NORMALISERS:
        raise ValueError(f"unknown source: {source}")
    return NORMALISERS[source](parsed(df))
