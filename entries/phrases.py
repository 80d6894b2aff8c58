"""Phrases that carry the words of the rules. Our own wording."""

PHRASES = (
    "Built a Flask API in Python",
    "Python, Flask, Docker",
    "Summary",
    "React developer",
    "BSc Computer Science completed in 2021",
    "Used PostgreSQL and MySQL for the sales dataset in one reporting project",
    "GitHub",
    "Skills",
    "Seeking data analyst roles",
    "Team player",
    "Target role: junior software engineer",
    "Built project at https://example.com/x",
    "Analysed sales data with SQL and Excel. The dashboard project identified churn and a chart shows the finding",
    "Education",
    "Higher Certificate in information technology, in progress",
    "Collaborated with a customer and resolved the incident",
    "Google Sheets and Tableau",
    "Debugged unit tests with pytest and wrote documentation for the repository",
    "Wrote SQL queries from the source database to Power BI for a business question",
    "Dashboard screenshot",
    "Projects",
    "Automated a workflow in R with pandas and NumPy that reduced missing values",
    "Junior data analyst",
    "Data analyst at Acme 2022",
    "Responsible for deadline planning, a detail-oriented problem solver",
    "Bootcamp certificate earned",
    "Deployed the REST API service on AWS with Docker to solve a client problem",
    "JavaScript, TypeScript, C# and .NET",
    "Presented insights to a stakeholder and validated data quality",
    "Git, GitLab",
    "Experience",
    "Cleaned data with Power Query. Data cleaning improved accuracy of the report",
    "Self-taught, took ownership of a personal project",
    "Bachelor of Statistics, currently enrolled, completed first year",
    "Designed a database schema and table joins with SQL Server",
    "Spring Boot, Django, FastAPI, Node.js and Express.js were used during a long course that covered many small exercises, none of them finished, and that only names the tools without saying what has been done with any of them, so that it counts as a list of names and nothing more than that",
    "Notebook with README, setup and how to run it",
)

JOB_PHRASES = (
    "Job title: Junior Software Developer",
    "Requirements: 0-2 years of experience. JavaScript, React and Git are required",
    "A degree is preferred, and we welcome every applicant who can show good work of any kind",
    "Submit your GitHub profile",
    "Location: Cape Town",
    "Excellent written and verbal communication skills and willingness to learn are important for this role",
    "Company: Acme Data",
    "Based in Johannesburg, Gauteng. This is a hybrid role",
    "SQL, advanced Excel with pivot tables, Power BI and Python",
    "Senior Data Analyst",
    "No prior experience is required",
    "A portfolio is preferred but optional",
    "Minimum of 3 years, must know Docker, AWS and PostgreSQL",
    "Fully remote",
    "You will clean raw data, present findings to non-technical stakeholders and prepare written reports",
    "Knowledge of Node.js, .NET and C# is essential. Experience with SQL Server and MongoDB",
    "Up to 4 years",
    "Graduate programme with mentorship provided",
    "On-site in Durban, South Africa",
    "Statistics, data modelling and R",
    "5+ years",
    "About us: equal opportunity and many benefits, requirements apply",
    "Problem-solving, time management, critical thinking",
    "National Diploma or certificate",
    "pandas, NumPy and matplotlib",
    "Tableau, Looker Studio and Google Sheets",
    "Software engineer intern",
    "Bachelor's degree in statistics is a must, this qualification is mandatory for the position",
    "Cookie settings",
    "TypeScript, Angular, HTML/CSS and PHP",
    "Java, Spring and Kubernetes on Azure",
)
