"""Fixed values of the action catalogue.

Fixed values: texts a result has to repeat word for word. The 212 actions follow from these rows
and the four templates by rule, see ``tables.action_rows``.
"""

# Fixed values: (anchor, action type, instruction template).
TEMPLATES = (
    ("missing_unverifiable", "create_evidence", "Create evidence for {label}: {target}."),
    ("named_only", "add_context", "Replace the isolated {label} label with contextual evidence: {target}."),
    ("documented", "demonstrate_evidence", "Publish or attach direct proof for {label}: {target}."),
    (
        "demonstrated",
        "package_evidence",
        "Package the existing {label} proof so a reviewer can find and verify it quickly: {target}.",
    ),
)

# Fixed values: (criterion, evidence target, required output, completion check).
MATRIX = (
    (
        "se.core.programming_language",
        "publish a small working feature in one explicitly named language and explain what the code does",
        "Accessible source code plus a short language-specific implementation note",
        "The language is named explicitly and a reviewer can locate code that implements a working behaviour",
    ),
    (
        "se.core.programming_concepts",
        "show control flow, data handling, decomposition, and a technical decision inside working code",
        "Focused code example plus a note explaining the problem and chosen approach",
        "The example contains an inspectable implementation and the explanation matches the code",
    ),
    (
        "se.core.application_systems",
        "show a complete input-to-result application or API flow, including one controlled failure",
        "Working flow, request or screen evidence, and failure-path evidence",
        "A reviewer can follow the normal path and trigger or inspect the failed path",
    ),
    (
        "se.core.database_fundamentals",
        "show a relational model, deliberate relationships, constraints, and purposeful queries",
        "Schema or migrations, seeded records, and query examples",
        "Relationships and constraints are visible and the queries return explainable results",
    ),
    (
        "se.core.debugging_testing",
        "record a defect or invalid case, the diagnosis, the fix, and the verification",
        "Automated test or documented manual check plus a short debugging record",
        "The original failure and successful verification are both reproducible or inspectable",
    ),
    (
        "se.tools.version_control",
        "show Git used throughout the work through meaningful, traceable changes",
        "Repository history with staged commits and a brief workflow note",
        "Commit history reflects progressive work rather than a single bulk upload",
    ),
    (
        "se.tools.framework_library",
        "use one explicitly named framework or library for a clear responsibility",
        "Working framework/library implementation and dependency declaration",
        "The named tool is visible in the project and its role is explained accurately",
    ),
    (
        "se.tools.database_platform",
        "configure and use an explicitly named database platform in a working flow",
        "Setup configuration, schema or migrations, and sample data",
        "Another developer can identify the platform and initialise the data layer",
    ),
    (
        "se.tools.dev_environment",
        "document the commands, dependencies, configuration, and environment needed to run the work",
        "Reproducible setup section and safe example configuration",
        "A clean setup can reach the documented start or test command without hidden steps",
    ),
    (
        "se.tools.repository_platform",
        "use an accessible repository platform with inspectable collaboration or repository-management behaviour",
        "Repository link plus issue, pull-request, review, or equivalent workflow evidence",
        "The platform use shows more than the existence of a profile or repository",
    ),
    (
        "se.tools.deployment_cloud",
        "publish a stable deployment, container setup, or documented cloud workflow with safe configuration",
        "Deployed link or container/cloud configuration plus operating notes",
        "The result starts reliably and secrets or private configuration are excluded",
    ),
    (
        "se.projects.accessibility",
        "provide a direct candidate-submitted link that opens without special permission",
        "Accessible repository, deployed project, or portfolio link",
        "The submitted link opens and leads directly to the claimed project evidence",
    ),
    (
        "se.projects.problem_relevance",
        "state the user, problem, scope, and Software Engineering relevance",
        "Project brief or README problem section",
        "The problem and main workflow are clear before reading the implementation",
    ),
    (
        "se.projects.depth_ownership",
        "expose the central implementation decisions and identify the candidate's contribution",
        "Architecture or decision note linked to working code",
        "A reviewer can distinguish the candidate's work and reach meaningful implementation detail",
    ),
    (
        "se.projects.documentation",
        "document setup, structure, decisions, normal use, failure paths, and current limits",
        "Complete README or equivalent technical guide",
        "Another developer can navigate and run or inspect the project from the documentation",
    ),
    (
        "se.projects.outcome",
        "show the working result and the expected response to at least one failure",
        "Short demo, screenshots, sample requests, or test output",
        "The main outcome and a controlled failure are visible without relying on a CV claim",
    ),
    (
        "se.alignment.target_role",
        "align the CV headline, evidence order, and selected stack to one Software Engineering direction",
        "Updated CV section and target-role statement",
        "The stated target and strongest evidence describe the same type of work",
    ),
    (
        "se.alignment.claim_specificity",
        "replace broad skill claims with the exact tool, task, context, and contribution",
        "Revised skills and experience wording",
        "Each retained claim points to a specific use, responsibility, or evidence source",
    ),
    (
        "se.alignment.description_evidence",
        "describe action, technical process, output, and verified outcome without invented metrics",
        "Revised project or experience bullets",
        "Every outcome is supported by submitted evidence and no unsupported number is added",
    ),
    (
        "se.alignment.readability",
        "create a consistent reading order with clear headings, dates, spacing, and concise evidence-led content",
        "Updated text-readable CV",
        "A reviewer can find target role, recent experience, skills, and project links quickly",
    ),
    (
        "se.readiness.communication",
        "publish a concise technical explanation written for another person",
        "README section, handover note, user guide, or technical decision note",
        "The document names its reader and explains the relevant process or decision clearly",
    ),
    (
        "se.readiness.collaboration",
        "show an attributable team contribution, review exchange, requirement discussion, or shared delivery",
        "Pull request, review, requirement record, or truthful experience bullet",
        "The candidate's contribution and the other party's role are distinguishable",
    ),
    (
        "se.readiness.professional_exposure",
        "document a real work, internship, freelance, volunteer, or client responsibility and its deliverable",
        "Evidence-led experience entry or attributable work artifact",
        "The organisation or context, responsibility, and output are stated without inflated seniority",
    ),
    (
        "se.readiness.initiative",
        "show a self-directed improvement, recovery, or build decision carried through to an output",
        "Decision note, issue history, or project improvement record",
        "The starting gap, chosen action, and completed output are visible",
    ),
    (
        "se.readiness.self_management",
        "show how a problem was scoped, investigated, resolved, and checked",
        "Debugging, incident, task, or decision record",
        "The record connects the problem, actions, result, and verification",
    ),
    (
        "da.core.sql",
        "publish explicit SQL that filters, joins, aggregates, and validates data for a named question",
        "Ordered SQL files plus result or validation evidence",
        "Queries run in the documented order and outputs reconcile to a stated check",
    ),
    (
        "da.core.spreadsheets",
        "show spreadsheet analysis using formulas, lookups, pivots, controls, or validation appropriate to the question",
        "Inspectable Excel or Google Sheets workbook with control notes",
        "Key calculations are visible and an independent total or exception check is included",
    ),
    (
        "da.core.analysis_statistics",
        "define the analytical unit, select defensible measures, compare results, and test an alternative view",
        "Analysis note with measures, denominators, comparisons, and interpretation",
        "Counts, rates, averages, or changes use the correct grain and the conclusion survives a stated check",
    ),
    (
        "da.core.cleaning",
        "record explicit treatments for missing values, duplicates, categories, types, and extreme observations",
        "Cleaning log plus before-and-after validation counts",
        "Every material change maps to a written rule and rejected or changed records remain auditable",
    ),
    (
        "da.core.reporting",
        "communicate the finding, its decision context, and its limitations to a named reader",
        "Insight memo, report page, or dashboard narrative",
        "The output separates observation, interpretation, recommendation, and limitation",
    ),
    (
        "da.tools.bi_visualisation",
        "build an inspectable dashboard or visual report with a clear model, measures, filters, and reading order",
        "BI file or equivalent artifact plus screenshots or PDF",
        "Visuals answer the named question and filters preserve intended denominators",
    ),
    (
        "da.tools.power_bi_alignment",
        "explicitly show Power BI in a submitted artifact or evidence description",
        "Power BI file, published report evidence, screenshot, or specific project description",
        "Power BI is named explicitly and its role in the workflow is clear",
    ),
    (
        "da.tools.programming",
        "use explicitly named Python or R code to add repeatability, scale, or analytical depth",
        "Reproducible script or notebook with dependency and run notes",
        "The code performs a meaningful analytical step and produces an inspectable output",
    ),
    (
        "da.tools.database_environment",
        "show an explicitly named database or data environment connected to the analytical workflow",
        "Source description, connection-safe setup notes, and queries or model evidence",
        "The environment and its role can be identified without exposing credentials",
    ),
    (
        "da.tools.transformation_cloud",
        "implement repeatable transformation or platform steps in an explicitly named tool",
        "Power Query, dbt, pipeline, cloud, Python, or R transformation artifact",
        "A second input can pass through the documented transformation and quality checks",
    ),
    (
        "da.tools.integration",
        "connect at least two named tools in one traceable data-to-output workflow",
        "Workflow note showing source, transformation, analysis, and output hand-offs",
        "A reviewer can trace the same records or measures across the tool boundary",
    ),
    (
        "da.projects.accessibility",
        "provide a direct candidate-submitted link that opens without special permission",
        "Accessible repository, dashboard, workbook, report, or portfolio link",
        "The submitted link opens and leads directly to the claimed analytical evidence",
    ),
    (
        "da.projects.context",
        "state the intended user, decision, dataset, reporting period, and analytical question",
        "Project brief and dataset declaration",
        "The question and unit of analysis are clear before the results are presented",
    ),
    (
        "da.projects.process",
        "expose cleaning, exploration, calculation, and validation steps in a reproducible order",
        "Queries, script, workbook, or transformation log",
        "A reviewer can follow how raw records became the analytical result",
    ),
    (
        "da.projects.findings",
        "present supported findings with useful visuals, denominator checks, and limitations",
        "Insight memo and visual output",
        "Findings match the calculations and do not turn correlation into an unsupported cause",
    ),
    (
        "da.projects.reproducibility",
        "package source declarations, file order, dependencies, refresh steps, and expected outputs",
        "README, refresh guide, and organised project files",
        "Another reviewer can reproduce or audit the result from the included instructions",
    ),
    (
        "da.alignment.target_role",
        "align the CV headline, evidence order, and selected tools to one Data Analytics direction",
        "Updated CV section and target-role statement",
        "The stated target and strongest evidence describe the same analytical work",
    ),
    (
        "da.alignment.claim_specificity",
        "replace broad analytical claims with the exact tool, question, process, and contribution",
        "Revised skills and experience wording",
        "Each retained claim points to a specific use, responsibility, or evidence source",
    ),
    (
        "da.alignment.description_evidence",
        "describe the question, analytical process, output, and supported decision context without invented metrics",
        "Revised project or experience bullets",
        "Every outcome is supported by submitted evidence and no unsupported number is added",
    ),
    (
        "da.alignment.readability",
        "create a consistent reading order with clear headings, dates, spacing, and concise evidence-led content",
        "Updated text-readable CV",
        "A reviewer can find target role, analytical tools, recent experience, and project links quickly",
    ),
    (
        "da.readiness.problem_solving",
        "show how an analytical problem was framed, investigated, checked, and resolved",
        "Analysis, issue, or decision record",
        "The record connects the question, method, result, and validation",
    ),
    (
        "da.readiness.attention_detail",
        "expose a material data-quality, boundary, denominator, or reconciliation check",
        "Validation table, exception report, or cleaning log",
        "The check identifies what was tested and how discrepancies were handled",
    ),
    (
        "da.readiness.collaboration",
        "show an attributable stakeholder, reviewer, or team interaction that changed or validated the work",
        "Requirement note, review record, handover, or truthful experience bullet",
        "The candidate's contribution and the other party's input are distinguishable",
    ),
    (
        "da.readiness.communication",
        "explain a finding, metric, limitation, or action to a named non-technical reader",
        "Insight memo, dashboard note, presentation, or handover",
        "The output states what the reader should understand or investigate next",
    ),
    (
        "da.readiness.self_management",
        "show how scope, files, assumptions, tasks, and validation were controlled through completion",
        "Project log, issue history, analysis plan, or decision record",
        "The record connects the starting question, work sequence, result, and completion check",
    ),
)

# Fixed values: (route, action type, instruction, required output, completion check).
ROUTE_ACTIONS = (
    (
        "completed",
        "package_qualification",
        "State the completed relevant qualification precisely and place it where a reviewer can verify the award and field.",
        "Qualification name, institution, completion status, and year; optional safe supporting link or document reference",
        "The wording matches the submitted evidence and does not imply unverified technical skills",
    ),
    (
        "in_progress",
        "package_qualification",
        "State the relevant qualification as in progress, including the institution and expected or current study status without implying completion.",
        "Qualification name, institution, in-progress status, and truthful date context",
        "The status is unambiguous and consistent across the CV and submitted evidence",
    ),
    (
        "experience",
        "package_qualification",
        "Present the substantial equivalent experience through specific responsibilities, duration, and attributable technical or analytical outputs.",
        "Evidence-led experience entries and linked work where safely available",
        "The experience route is supported without converting the job title into assumed skills",
    ),
    (
        "bootcamp",
        "package_qualification",
        "Pair the relevant bootcamp or certification with accessible applied work that shows how the learning was used.",
        "Training details plus linked applied project or work evidence",
        "The training and applied evidence are both explicit and independently attributable",
    ),
    (
        "adjacent",
        "package_qualification",
        "State the adjacent qualification accurately and connect only the relevant upskilling or applied evidence that is actually present.",
        "Adjacent qualification details plus truthful relevant training or project evidence",
        "The relationship to the selected track is explained without re-labelling the qualification",
    ),
    (
        "none",
        "access_strategy",
        "Do not invent or obscure qualification status. Strengthen applied evidence and concentrate applications on roles whose wording accepts equivalent experience, training, or demonstrable work.",
        "Truthful education section, stronger applied evidence, and a recorded vacancy-filter rule",
        "The CV remains accurate and the target list does not depend on a qualification the candidate does not hold",
    ),
)
