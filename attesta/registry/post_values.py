"""Fixed values of job-post extraction: vocabularies, phrases and names.

Fixed values: labels and patterns have to equal the published collection rules.
"""

# Vocabulary -> label -> patterns.
VOCABULARIES = {
    "languages": {
        "JavaScript": (r"\bjavascript\b", r"\bjava[ -]?script\b", r"\bjs\b",),
        "TypeScript": (r"\btypescript\b", r"\btype[ -]?script\b", r"\bts\b",),
        "Python": (r"\bpython\b",),
        "Java": (r"\bjava\b",),
        "C#": (r"(?<!\w)c#(?!\w)", r"\bc[ -]?sharp\b",),
        "PHP": (r"\bphp\b",),
        "HTML/CSS": (r"\bhtml5?\b", r"\bcss3?\b", r"\bhtml\s*/\s*css\b",),
        "SQL": (r"\bsql\b",),
    },
    "frameworks": {
        "React": (r"\breact(?:\.js|js)?\b",),
        "Angular": (r"\bangular(?:\.js|js)?\b",),
        "Vue": (r"\bvue(?:\.js|js)?\b",),
        "Node.js": (r"\bnode(?:\.js|js)?\b",),
        "Express": (r"\bexpress(?:\.js|js)?\b",),
        ".NET": (r"(?<!\w)\.net\b", r"\bdotnet\b", r"\basp\.net\b",),
        "Django": (r"\bdjango\b",),
        "Flask": (r"\bflask\b",),
    },
    "se_tools": {
        "Git/GitHub": (r"\bgit\b", r"\bgithub\b",),
        "VS Code": (r"\bvs\s*code\b", r"\bvisual studio code\b",),
        "Docker": (r"\bdocker\b",),
        "AWS": (r"\baws\b", r"\bamazon web services\b",),
        "Azure": (r"\bazure\b",),
        "GCP": (r"\bgcp\b", r"\bgoogle cloud(?: platform)?\b",),
        "Postman": (r"\bpostman\b",),
        "Jira": (r"\bjira\b",),
        "Linux": (r"\blinux\b",),
        "MySQL": (r"\bmysql\b",),
        "PostgreSQL": (r"\bpostgres(?:ql)?\b",),
        "SQL Server": (r"\b(?:microsoft\s+)?sql server\b", r"\bmssql\b",),
        "SQLite": (r"\bsqlite\b",),
        "MongoDB": (r"\bmongodb\b", r"\bmongo\s+db\b",),
        "Firebase": (r"\bfirebase\b",),
        "Supabase": (r"\bsupabase\b",),
        "Kubernetes": (r"\bkubernetes\b", r"\bk8s\b",),
    },
    "core": {
        "SQL": (r"\bsql\b",),
        "Excel (advanced)": (
            r"\badvanced excel\b",
            r"\bexcel[^.\n]{0,70}\b(?:pivot tables?|power query|vlookup|xlookup|macros?|power pivot)\b",
            r"\b(?:pivot tables?|power query|vlookup|xlookup|macros?|power pivot)\b[^.\n]{0,70}\bexcel\b",
        ),
        "Python": (r"\bpython\b",),
        "R": (r"(?<!\w)R(?!\w)",),
        "Statistics": (r"\bstatistics?\b", r"\bstatistical analysis\b",),
        "Data Cleaning": (r"\bdata clean(?:ing|sing)\b", r"\bclean(?:ing|se) (?:raw )?data\b",),
        "Data Modelling": (r"\bdata model(?:l?ing)?\b", r"\bdimensional model(?:l?ing)?\b",),
    },
    "reporting": {
        "Power BI": (r"\bpower\s*bi\b",),
        "Tableau": (r"\btableau\b",),
        "Google Data Studio / Looker Studio": (r"\bgoogle data studio\b", r"\blooker studio\b",),
        "Excel (dashboards/pivot tables)": (
            r"\bexcel[^.\n]{0,70}\b(?:dashboards?|pivot tables?)\b",
            r"\b(?:dashboards?|pivot tables?)\b[^.\n]{0,70}\bexcel\b",
        ),
    },
    "da_tools": {
        "Excel": (r"\b(?:microsoft\s+|ms\s+)?excel\b",),
        "SQL Server / MySQL / PostgreSQL": (
            r"\b(?:microsoft\s+)?sql server\b",
            r"\bmssql\b",
            r"\bmysql\b",
            r"\bpostgres(?:ql)?\b",
        ),
        "Google Sheets": (r"\bgoogle sheets\b",),
        "Jira": (r"\bjira\b",),
        "Power Query": (r"\bpower query\b",),
        "BigQuery": (r"\bbigquery\b", r"\bbig query\b",),
        "Microsoft Fabric": (r"\bmicrosoft fabric\b",),
        "pandas": (r"\bpandas\b",),
        "NumPy": (r"\bnumpy\b",),
        "matplotlib": (r"\bmatplotlib\b",),
        "seaborn": (r"\bseaborn\b",),
    },
}

# Phrases quoted as soft skills.
SOFT_SKILLS = (
    r"\battention to detail\b",
    r"\bexcellent written and verbal communication(?: skills)?\b",
    r"\bwritten and verbal communication(?: skills)?\b",
    r"\bcommunication skills\b",
    r"\bproblem[- ]solving(?: skills)?\b",
    r"\banalytical thinking\b",
    r"\bcritical thinking\b",
    r"\btime management\b",
    r"\binterpersonal skills\b",
    r"\bteam(?:work| player)\b",
    r"\bcollaborat(?:e|ion|ive)(?: skills)?\b",
    r"\borganisational skills\b",
    r"\borganizational skills\b",
    r"\badaptab(?:le|ility)\b",
    r"\bself[- ]motivated\b",
)

# Phrases quoted as readiness signals.
READINESS = (
    r"\bwilling(?:ness)? to learn\b",
    r"\beager to learn\b",
    r"\bcontinuous learning\b",
    r"\bwork(?:ing)? independently\b",
    r"\btake ownership\b",
    r"\bmanage competing priorities\b",
    r"\bcommunicat(?:e|ing) with (?:non-technical )?stakeholders\b",
    r"\bpresent(?:ing)? (?:data |technical )?(?:findings|insights|results) to (?:non-technical )?stakeholders\b",
    r"\bpresent(?:ing)? (?:data |technical )?(?:findings|insights|results)\b",
    r"\bprepare (?:written )?reports\b",
    r"\bwrite (?:clear )?(?:technical )?documentation\b",
    r"\bclient[- ]facing\b",
    r"\bcross[- ]functional (?:team|environment|collaboration)\b",
    r"\bmentorship (?:is )?provided\b",
    r"\bon[- ]the[- ]job training\b",
    r"\bgraduate programme\b",
    r"\bgraduate program\b",
    r"\binternship experience\b",
)

# Job boards by host.
BOARDS = {
    "linkedin.com": "LinkedIn",
    "indeed.com": "Indeed",
    "indeed.co.za": "Indeed",
    "pnet.co.za": "PNet",
    "careers24.com": "Careers24",
    "offerzen.com": "OfferZen",
    "glassdoor.com": "Glassdoor",
    "careerjunction.co.za": "CareerJunction",
    "simplify.hr": "Simplify",
}

# Place names, in the order they are searched.
PLACES = (
    "Johannesburg", "Pretoria", "Cape Town", "Durban", "Centurion", "Midrand", "Sandton",
    "Stellenbosch", "Gauteng", "Western Cape", "KwaZulu-Natal", "South Africa",
)

# Paragraphs that belong to the page frame.
PAGE_FRAME = (
    "sign in", "log in", "register", "accept cookies", "privacy policy", "terms of use",
    "skip to main content", "share", "save job", "apply now",
)

# Fixed values: (years pattern, how the years are shown).
YEARS = (
    (r"\b(\d{1,2})\s*(?:-|–|—|to)\s*(\d{1,2})\s*\+?\s*(?:years?|yrs?)\b", "range"),
    (r"\b(?:minimum|min\.?|at least)\s*(?:of\s*)?(\d{1,2})\s*\+?\s*(?:years?|yrs?)\b", "minimum"),
    (r"\b(\d{1,2})\s*\+\s*(?:years?|yrs?)\b", "open"),
    (r"\b(?:up to|maximum of|max\.?)\s*(\d{1,2})\s*(?:years?|yrs?)\b", "limit"),
    (r"\b(\d{1,2})\s*(?:years?|yrs?)\s+(?:of\s+)?(?:relevant\s+)?experience\b", "plain"),
)
NO_EXPERIENCE = r"\bno (?:prior |previous )?experience (?:is )?required\b"

# Patterns on degrees and certificates.
DEGREE = r"\b(?:bachelor'?s?|degree|bsc|bcom|national diploma|diploma|tertiary qualification)\b"
DEGREE_REQUIRED = r"\b(?:required|must|minimum|essential|mandatory)\b"
DEGREE_PREFERRED = r"\b(?:preferred|advantageous|nice to have|beneficial|desirable)\b"
CERTIFICATE = r"\b(?:certificate|certification|bootcamp)\b"

# Patterns on portfolio requests, tried in this order.
PORTFOLIO = (
    r"\b(?:submit|share|provide|include|send)(?: a| your)? (?:link to (?:your )?)?"
    r"(?:portfolio|github(?: profile| account)?|code samples?)\b",
    r"\b(?:portfolio|github profile|github account|code samples?) (?:is |are )?"
    r"(?:required|requested|preferred|essential|mandatory)\b",
    r"\bapply with (?:a |your )?(?:portfolio|github)\b",
)
PORTFOLIO_OPTIONAL = r"\bpreferred|nice to have|advantageous|optional|bonus\b"

# Patterns on titles, work type and requirement paragraphs.
ROLE_WORDS = (
    r"\b(?:developer|engineer|analyst|technician|programmer|tester|data scientist|"
    r"software support|graduate|intern)\b"
)
SENIOR = r"\b(?:senior|lead|principal|staff)\b"
WORK_TYPES = (
    ("Remote", r"\bfully remote\b|\bremote role\b"),
    ("Hybrid", r"\bhybrid\b"),
    ("On-site", r"\bon[- ]site\b|\bonsite\b|\boffice[- ]based\b"),
)
REQUIREMENT_WORDS = (
    r"\brequirements?\b|\bqualifications?\b|\bskills?\b|\bexperience\b|"
    r"\bmust\b|\bpreferred\b|\bknowledge of\b|\bproficien(?:t|cy)\b"
)
PAGE_TALK = "about us|equal opportunity|privacy|cookie|benefits"
COUNTRY = r"\b(?:south africa|za|zaf)\b"
LIBRARIES = ("pandas", "NumPy", "matplotlib", "seaborn")
SE_FLAG = r"\bgit(?:hub)?\b"
DA_FLAG = r"\bsql\b"
TRACK_CODES = {"SE Track": "SE", "DA Track": "DA"}
