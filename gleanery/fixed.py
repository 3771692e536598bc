"""Words, keys, thresholds and formats that results depend on."""

MISSING = ["", "n/a", "na", "none", "null", "open job", "open apply"]
SOURCE_LABELS = {"linkedin": "LinkedIn", "indeed": "Indeed", "stepstone": "Stepstone", "xing": "Xing"}
SOURCE_ALIASES = {"linked in": "linkedin", "linkedin": "linkedin", "indeed": "indeed", "stepstone": "stepstone", "stepstone de": "stepstone", "xing": "xing", "xing jobs": "xing"}
SOURCE_ORDER = ["linkedin", "indeed", "stepstone", "xing"]
LEGAL_SUFFIXES = ["ab", "ag", "bv", "co", "company", "corp", "corporation", "gbr", "gmbh", "group", "holding", "holdings", "inc", "kg", "limited", "llc", "ltd", "mbh", "nv", "oy", "plc", "sarl", "se", "ug"]
TITLE_NOISE = ["all", "contract", "d", "div", "f", "full", "fulltime", "gender", "genders", "gn", "home", "homeoffice", "hybrid", "job", "jobs", "m", "office", "onsite", "part", "parttime", "permanent", "remote", "site", "teilzeit", "time", "vollzeit", "w", "x"]
COUNTRY_TOKENS = ["de", "deu", "deutschland", "germany"]
LOCATION_NOISE = ["home", "homeoffice", "hybrid", "office", "on", "onsite", "remote", "site", "work"]
CITY_ALIASES = {
    "cologne": "koln", "koeln": "koln", "köln": "koln", "munich": "munchen", "muenchen": "munchen", "münchen": "munchen",
    "nuremberg": "nurnberg", "nuernberg": "nurnberg", "nürnberg": "nurnberg",
}
JOB_TYPES = {
    "full time": "fulltime", "full-time": "fulltime", "vollzeit": "fulltime", "part time": "parttime", "part-time": "parttime", "teilzeit": "parttime",
    "internship": "internship", "praktikum": "internship", "contract": "contract", "contractor": "contract", "freelance": "freelance", "permanent": "permanent",
}
JOB_TYPE_NOISE = ["m", "f", "d", "w", "x", "all", "gender", "genders"]
REMOTE_WORDS = ["remote", "home office", "home-office", "homeoffice", "work from home"]
HYBRID_WORDS = ["hybrid", "teilweise remote"]
ONSITE_WORDS = ["onsite", "on-site", "vor ort", "praesenz", "präsenz"]
#: In two providers' items, where "homeoffice" in one word doesn't count.
ITEM_REMOTE_WORDS = ["remote", "home office", "home-office", "work from home"]
TRACKING_PREFIX = "utm_"
TRACKING_KEYS = ["from", "ref", "refid", "rltr", "src", "trk", "trackingid"]
PLATFORM_HOSTS = ["linkedin.com", "indeed.", "stepstone.", "xing."]
SENIORITY_JUNIOR = ["intern", "junior", "jr"]
SENIORITY_SENIOR = ["senior", "sr", "lead", "principal", "staff", "head", "director"]
ROLE_FAMILIES = ["administrator", "analyst", "analytics", "architect", "consultant", "developer", "engineer", "manager", "scientist", "specialist"]
THRESHOLDS = {"company": 0.90, "title": 0.82, "location": 0.82, "job_type": 0.70, "posted_time": 0.55}
WEIGHTS = {"company": 0.30, "title": 0.34, "location": 0.18, "job_type": 0.10, "posted_time": 0.08}
MATCH_THRESHOLD = 0.88
BENEFIT_WORDS = ["insurance", "leave", "paid time", "pto", "benefit", "retirement", "401", "pension", "stock", "wellness", "commuter", "dental", "vision", "health"]
EDUCATION_WORDS = ["degree", "bachelor", "master", "phd", "doctorate", "diploma", "certification"]
TAG_JOB_TYPES = ["full-time", "part-time", "contract", "temporary", "internship", "permanent", "freelance"]
#: Of Stepstone, in order.
HEARD_JOB_TYPES = ["full-time", "part-time", "teilzeit", "vollzeit", "contract", "permanent", "internship", "praktikum", "freelance"]
SENIORITY_WORDS = ["intern", "entry", "junior", "mid", "senior", "lead", "principal", "staff", "director", "manager"]
LANGUAGES = ["python", "sql", "java", "javascript", "typescript", "r", "c++", "c#", "scala", "go", "rust", "matlab", "kotlin", "swift", "php"]
SKILL_WORDS = ["analytics", "analysis", "aws", "azure", "bigquery", "communication", "data", "docker", "excel", "gis", "kubernetes", "machine learning", "power bi", "spark", "tableau"]
MAX_CELL = 49_000
#: Aliases of raw fields, first wins.
TITLE_KEYS = ["title", "positionName", "jobTitle", "job_title", "name"]
COMPANY_KEYS = ["companyDetails.name", "employer.name", "companyName", "company", "organization", "jobSourceName"]
LOCATION_KEYS = ["location", "formattedLocation", "jobLocation", "place"]
LOCATION_FIELDS = ["location.formatted.long", "location.formatted", "location.fullAddress", "location.city"]
LOCATION_PARTS = ["location.admin1Code", "location.countryName"]
JOB_TYPE_KEYS = ["employmentType", "employment_type", "jobType", "job_type", "contractType", "contract_type", "type", "jobTypes"]
JOB_URL_KEYS = ["jobUrl", "job_url", "linkedinUrl", "linkedin_url", "url", "link"]
PROVIDER_URL_KEYS = ["url", "link", "jobUrl", "job_url"]
APPLY_URL_KEYS = ["applyUrl", "apply_url", "originalApplyUrl", "thirdPartyApplyUrl", "externalApplyLink", "applicationUrl", "applicationLink"]
COMPANY_URL_KEYS = ["companyUrl", "company_url", "companyDetails.url", "employer.url"]
JOB_ID_KEYS = ["jobId", "job_id", "indeedKey", "stepstoneId", "harmonisedId", "xingId", "key", "jobKey", "id"]
LINK_ID_KEYS = ["jobId", "job_id", "id"]
POSTED_KEYS = ["postedAt", "posted_at", "publishedAt", "published_at", "datePublished", "date_published", "dateOnIndeed", "date_on_indeed", "datePosted", "date_posted", "posted", "listedAt", "listed_at", "pubDate"]
DESCRIPTION_KEYS = [
    "descriptionText", "description_text", "jobDescriptionText", "job_description_text", "descriptionPlainText", "description_plain_text",
    "jobDescriptionPlainText", "job_description_plain_text", "aboutTheJob", "about_the_job", "jobDescription", "job_description", "description",
    "descriptionHtml", "description_html", "jobDescriptionHtml", "job_description_html", "jobDetails", "job_details", "details", "summary", "snippet",
]
#: Of which the longest counts.
LONG_DESCRIPTION_KEYS = [
    "descriptionText", "description_text", "jobDescriptionText", "job_description_text", "descriptionPlainText", "description_plain_text",
    "jobDescriptionPlainText", "job_description_plain_text", "jobDescription", "job_description", "description",
]
DESCRIPTION_FIELDS = ["text", "html", "content", "value"]
SALARY_KEYS = ["salary", "salaryText", "salary_text", "salarySnippet", "salary_snippet", "salaryRange", "salary_range"]
SEARCH_URL_KEYS = ["inputUrl", "input_url", "searchUrl", "search_url", "startUrl", "start_url", "requestUrl", "request_url"]
INDEED_HOSTS = {
    "us": "www.indeed.com", "gb": "uk.indeed.com", "uk": "uk.indeed.com", "de": "de.indeed.com", "at": "at.indeed.com", "ch": "ch.indeed.com",
    "fr": "fr.indeed.com", "nl": "nl.indeed.com", "it": "it.indeed.com", "es": "es.indeed.com", "ca": "ca.indeed.com", "au": "au.indeed.com",
}
APPLICANT_KEYS = ["applicantsCount", "applicants_count", "applicantCount", "applicant_count", "numberOfApplicants", "number_of_applicants", "numApplicants", "num_applicants", "formattedApplicantsCount", "applicantsLabel", "applicants"]
AI_COLUMNS = ["AI Verdict", "AI Fit Score", "AI Unsuitable Reasons", "AI Tailored CV", "AI CV PDF"]
LEGACY_AI_COLUMNS = ["AI Category", "AI Reason", "AI Raw Verdict", "AI Evaluated At", "AI Model", "AI Error"]
DETAIL_COLUMNS = ["Job Description", "Description", "Details", "Job Details"]
EXPORT_COLUMNS = ["Application Status", "App", "Job Title", "Company", "Location", "Job Type", "Job Description", "Posted", "Applicants", "Keywords Matched", "Job URL", "Apply URL", *AI_COLUMNS]
MAX_SCORE = 26
MIN_ADVERTISEMENT = 20
#: Sections of a CV that a model may not change: title, other titles that a model gives it, and sections that it belongs before.
PROTECTED_SECTIONS = ["Ausbildung"]
EDUCATION_TITLES = ["Ausbildung", "Education", "Bildung", "Qualifikation", "Qualifikationen"]
EDUCATION_BEFORE = ["Berufserfahrung", "Experience", "Projekte", "Projects", "Technische Fähigkeiten", "Technical Skills", "Sprachen", "Languages"]
NO_CV = ["n/a", "na", "none", "null", "not applicable"]
COMPANY_SUFFIXES = ["ag", "co", "company", "corp", "corporation", "gmbh", "group", "inc", "kg", "limited", "llc", "ltd", "mbh", "se", "ug"]
UNSAFE_LATEX = ["input", "include", "includeonly", "import", "subimport", "openin", "openout", "read", "write", "write18", "catcode", "csname", "newread", "newwrite"]
FONT_BLOCK = r"""\usepackage{fontspec}
\defaultfontfeatures{Ligatures=TeX}
\setmainfont{lmroman10-regular.otf}[
  BoldFont=lmroman10-bold.otf,
  ItalicFont=lmroman10-italic.otf,
  BoldItalicFont=lmroman10-bolditalic.otf
]"""
MAX_LOG, MAX_STEM, MAX_FILE_NAME = 4000, 156, 120
MAX_PAGES, SHORTENINGS = 2, 2
TERMINAL_STATES = ["SUCCEEDED", "FAILED", "ABORTED", "TIMED-OUT"]
RETRYABLE_STATUSES = [408, 429, 500, 502, 503, 504]
CREDIT_TERMS = [
    "not enough credit", "no credit", "no credits", "out of credit", "out of credits", "credits exhausted", "credit balance", "not enough funds", "insufficient credit",
    "insufficient funds", "insufficient balance", "account balance", "payment required", "billing", "prepaid", "usage limit", "out of funds", "add a payment method",
]
SOURCES_THAT_MAY_FAIL = ["stepstone", "xing"]
#: Of a spreadsheet service: ranges in one read, requests in one write.
RANGES_AT_ONCE, REQUESTS_AT_ONCE = 50, 500
SEEN_SHEET, SEEN_HEADER = "_seen_keys", "Job Key"
HISTORY_HEADERS = ["App", "Job Title", "Company", "Location", "Job Type", "Posted", "Apply URL"]
POSTED_HEADERS = ["Posted", "Posted Date", "Date Posted"]
