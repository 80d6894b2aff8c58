"""Fixed values of the evidence rules: aliases and cue phrases.

Fixed values: every name, word list and pattern here has to equal the published rule set,
otherwise results differ. They are stated as plain data, in their natural order.
"""

# Verbs that mark a sentence as applied work.
ACTION_CUES = (
    "build", "built", "develop", "developed", "implement", "implemented", "create", "created",
    "use", "used", "using", "design", "designed", "integrate", "integrated", "analyse",
    "analyzed", "analysed", "automate", "automated", "query", "queried", "clean", "cleaned",
    "transform", "transformed", "visualise", "visualize", "visualised", "visualized", "debug",
    "debugged", "test", "tested", "deploy", "deployed", "configure", "configured", "maintain",
    "maintained", "support", "supported", "optimise", "optimize", "optimised", "optimized",
    "migrate", "migrated", "model", "modelled", "modeled", "write", "wrote", "written",
)

# Fixed values: (kind, subject, aliases). The rule ID follows from kind and subject.
SUBJECT_ALIASES = (
    ("skill", "python", ("Python",)),
    ("skill", "java", ("Java",)),
    ("skill", "javascript", ("JavaScript",)),
    ("skill", "typescript", ("TypeScript",)),
    ("skill", "csharp", ("C#", "C Sharp",)),
    ("skill", "php", ("PHP",)),
    ("skill", "r", ("R", "R language",)),
    ("skill", "sql", ("SQL",)),
    ("skill", "html", ("HTML",)),
    ("skill", "css", ("CSS",)),
    ("skill", "object_oriented_programming", ("object-oriented programming", "object oriented programming", "OOP",)),
    ("skill", "data_structures", ("data structures",)),
    ("skill", "algorithms", ("algorithms",)),
    ("skill", "control_flow", ("control flow",)),
    ("skill", "api", ("API", "APIs",)),
    ("skill", "rest_api", ("REST API", "REST APIs", "RESTful API", "RESTful APIs",)),
    ("skill", "http", ("HTTP",)),
    ("skill", "relational_database", ("relational database", "relational databases",)),
    ("skill", "database_schema", ("database schema", "database schemas",)),
    ("skill", "database_normalization", ("database normalization", "database normalisation",)),
    ("skill", "database_joins", ("database joins", "table joins",)),
    ("skill", "debugging", ("debugging", "debugged",)),
    ("skill", "unit_testing", ("unit testing", "unit tests",)),
    ("skill", "integration_testing", ("integration testing", "integration tests",)),
    ("skill", "automated_testing", ("automated testing", "automated tests",)),
    ("skill", "data_analysis", ("data analysis", "data analytics",)),
    ("skill", "data_cleaning", ("data cleaning", "data cleansing",)),
    ("skill", "data_transformation", ("data transformation", "data transformations",)),
    ("skill", "statistics", ("statistics", "statistical analysis",)),
    ("skill", "data_visualization", ("data visualization", "data visualisation",)),
    ("skill", "data_modelling", ("data modelling", "data modeling",)),
    ("skill", "reporting", ("reporting",)),
    ("skill", "dashboarding", ("dashboard", "dashboards",)),
    ("tool", "dotnet", (".NET", "dotnet",)),
    ("tool", "aspnet", ("ASP.NET", "ASP NET",)),
    ("tool", "react", ("React", "React.js", "ReactJS",)),
    ("tool", "angular", ("Angular",)),
    ("tool", "vue", ("Vue", "Vue.js", "VueJS",)),
    ("tool", "nodejs", ("Node.js", "NodeJS",)),
    ("tool", "express", ("Express", "Express.js", "ExpressJS",)),
    ("tool", "spring", ("Spring", "Spring Boot",)),
    ("tool", "django", ("Django",)),
    ("tool", "flask", ("Flask",)),
    ("tool", "fastapi", ("FastAPI",)),
    ("tool", "postgresql", ("PostgreSQL", "Postgres",)),
    ("tool", "mysql", ("MySQL",)),
    ("tool", "sqlite", ("SQLite",)),
    ("tool", "sql_server", ("Microsoft SQL Server", "SQL Server", "MSSQL",)),
    ("tool", "mongodb", ("MongoDB",)),
    ("tool", "supabase", ("Supabase",)),
    ("tool", "git", ("Git",)),
    ("tool", "github", ("GitHub",)),
    ("tool", "gitlab", ("GitLab",)),
    ("tool", "bitbucket", ("Bitbucket",)),
    ("tool", "docker", ("Docker",)),
    ("tool", "kubernetes", ("Kubernetes", "K8s",)),
    ("tool", "azure", ("Microsoft Azure", "Azure",)),
    ("tool", "aws", ("Amazon Web Services", "AWS",)),
    ("tool", "gcp", ("Google Cloud Platform", "GCP",)),
    ("tool", "excel", ("Microsoft Excel", "Excel",)),
    ("tool", "google_sheets", ("Google Sheets",)),
    ("tool", "power_bi", ("Power BI", "PowerBI",)),
    ("tool", "tableau", ("Tableau",)),
    ("tool", "looker_studio", ("Looker Studio", "Google Data Studio",)),
    ("tool", "power_query", ("Power Query",)),
    ("tool", "dax", ("DAX",)),
    ("tool", "pandas", ("pandas",)),
    ("tool", "numpy", ("NumPy",)),
    ("tool", "pytest", ("pytest",)),
    ("tool", "jest", ("Jest",)),
    ("tool", "vitest", ("Vitest",)),
    ("tool", "playwright", ("Playwright",)),
    ("tool", "cypress", ("Cypress",)),
    ("qualification", "bachelor_degree", ("Bachelor's", "Bachelor", "B.Sc", "BSc", "B.Com", "BCom",)),
    ("qualification", "diploma", ("National Diploma", "Diploma",)),
    ("qualification", "higher_certificate", ("Higher Certificate",)),
    ("qualification", "certificate", ("Certification", "Certificate",)),
    ("qualification", "bootcamp", ("Boot Camp", "Bootcamp",)),
    ("qualification", "nqf", ("NQF",)),
)

# Aliases that match with exact case only.
CASE_SENSITIVE_ALIASES = ("R",)

# Cue phrases per cue group.
CUES = {
    "artifact_markers": (
        "project", "portfolio", "repository", "repo", "application", "app", "API", "service",
        "website", "system", "dashboard", "analysis", "report", "notebook", "pipeline",
        "workflow",
    ),
    "url_prefixes": (
        "https://", "http://",
    ),
    "repository_markers": (
        "GitHub", "GitLab", "Bitbucket", "portfolio",
    ),
    "context_markers": (
        "problem", "purpose", "requirement", "business", "user", "customer", "client", "patient",
        "operations", "workflow", "sales", "support", "dataset", "question", "KPI", "SLA",
        "to solve", "to address", "to improve", "to manage", "to track", "to investigate",
        "to analyse", "to analyze",
    ),
    "architecture_cues": (
        "architecture", "API", "database", "testing", "deployment",
    ),
    "integration_cues": (
        "integrate", "integrated", "combined", "with", "into",
    ),
    "documentation_cues": (
        "README", "documentation", "documented", "setup", "installation", "instructions",
        "requirements", "dependencies", "how to run", "run the", "tests", "sample request",
        "notebook", "data dictionary", "source code", "repository structure", "reproducible",
        "reproduce",
    ),
    "outcome_markers": (
        "deployed", "launched", "shipped", "released", "production", "delivered", "result",
        "outcome", "reduced", "increased", "improved", "saved", "automated", "resolved",
        "enabled", "generated", "identified", "found", "finding", "insight", "recommendation",
        "accuracy", "working",
    ),
    "findings_cues": (
        "finding", "findings", "insight", "insights", "recommendation", "recommendations",
    ),
    "visual_cues": (
        "report", "chart", "visual", "dashboard", "visualisation", "visualization",
    ),
    "forbidden_labels": (
        "team player", "good communicator", "excellent communication", "detail-oriented",
        "detail oriented", "hard worker", "problem solver", "self-starter", "fast learner",
    ),
    "collaboration_cues": (
        "collaborated", "partnered", "coordinated with", "worked with", "worked alongside",
        "cross-functional", "pair programmed", "code review", "peer review", "reviewed with",
    ),
    "communication_cues": (
        "presented", "documented", "wrote documentation", "explained", "trained", "liaised",
        "communicated with", "reported to", "gathered requirements", "stakeholder",
        "user training", "client communication",
    ),
    "professional_context_markers": (
        "client", "customer", "production", "SLA", "incident", "ticket", "on-call", "standby",
        "stakeholder", "manager", "internship", "intern", "responsible for",
    ),
    "initiative_cues": (
        "initiated", "proposed", "introduced", "proactively", "volunteered", "self-directed",
        "self-taught", "independently built", "personal project", "took ownership",
        "led implementation",
    ),
    "self_management_cues": (
        "prioritised", "prioritized", "managed workload", "deadline", "owned", "responsible for",
        "tracked", "maintained",
    ),
    "problem_solving_cues": (
        "troubleshot", "debugged", "diagnosed", "root cause", "investigated", "resolved",
    ),
    "attention_cues": (
        "validated", "verified", "reconciled", "quality check", "data quality", "accuracy",
        "duplicates", "missing values", "audited",
    ),
    "se_target_phrases": (
        "software engineer", "software developer", "junior software engineer",
        "junior software developer", "frontend developer", "front-end developer",
        "backend developer", "back-end developer", "full-stack developer",
        "full stack developer", "web developer", "application developer",
    ),
    "da_target_phrases": (
        "data analyst", "junior data analyst", "BI analyst", "business intelligence analyst",
        "reporting analyst",
    ),
    "target_cues": (
        "target role", "seeking", "applying for", "aspiring", "career objective", "career goal",
    ),
    "heading_cues": (
        "summary", "profile", "skills", "technical skills", "experience", "work experience",
        "education", "projects", "certifications", "qualifications",
    ),
    "completed_cues": (
        "completed", "graduated", "obtained", "earned", "awarded", "conferred",
    ),
    "in_progress_cues": (
        "in progress", "currently studying", "currently enrolled", "pursuing", "expected",
        "final year", "student",
    ),
    "se_relevant_fields": (
        "computer science", "software engineering", "information technology",
        "computer engineering", "informatics", "information systems",
    ),
    "da_relevant_fields": (
        "data analytics", "data analysis", "data science", "statistics", "business analytics",
        "information systems", "computer science", "information technology",
    ),
}

# Source types that count as project work.
PROJECT_SOURCE_TYPES = (
    "repository", "portfolio", "project", "deployed_project", "kaggle", "dashboard",
    "other_professional",
)

# Subjects that count as analysis work.
DA_ANALYSIS_SUBJECTS = (
    "sql", "excel", "google_sheets", "data_analysis", "statistics", "data_cleaning",
    "data_transformation", "data_visualization", "dashboarding", "power_bi", "tableau",
    "looker_studio", "python", "r", "pandas", "numpy", "postgresql", "mysql", "sqlite",
    "sql_server", "mongodb", "supabase", "relational_database",
)

# Fact type of each derived subject. The rule ID follows from both.
DERIVED_FACT_TYPES = {
    "project_proof": (
        "accessible_submitted_work", "cv_project_reference",
    ),
    "project_context": (
        "software_project_context", "analytics_project_context",
        "context_free_dashboard_screenshot",
    ),
    "project_process": (
        "se_technical_process", "se_technical_depth_ownership", "da_analysis_process",
        "da_tool_integration", "project_documentation", "project_reproducibility",
    ),
    "project_outcome": (
        "software_project_outcome", "analytics_project_outcome",
        "analytics_findings_visual_communication",
    ),
    "professional_behaviour": (
        "collaboration", "communication", "professional_exposure", "initiative",
        "self_management_problem_solving", "problem_solving", "self_management",
        "attention_to_detail",
    ),
    "role_alignment": (
        "software_engineering_target", "data_analytics_target",
    ),
    "document_quality": (
        "structured_readability", "claim_specificity", "description_evidence",
    ),
}
