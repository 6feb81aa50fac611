"""Word lists, lookup tables and constants that decide results.

Everything in this module is data.  Operators take these as defaults and accept
replacements, so a deployment can swap in its own vocabulary.
"""

# ---------------------------------------------------------------------------
# tokenizer
# ---------------------------------------------------------------------------
PHRASES = {
    "spring boot": "springboot",
    "spring cloud": "springcloud",
    "node.js": "nodejs",
    "node js": "nodejs",
    "react.js": "react",
    "reactjs": "react",
    "react native": "reactnative",
    "next.js": "nextjs",
    "vue.js": "vuejs",
    ".net": "dotnet",
    "c#": "csharp",
    "machine learning": "machinelearning",
    "deep learning": "deeplearning",
    "rest api": "restapi",
    "rest apis": "restapi",
    "github actions": "githubactions",
    "ci/cd": "cicd",
    "power bi": "powerbi",
    "full stack": "fullstack",
    "full-stack": "fullstack",
    "front end": "frontend",
    "front-end": "frontend",
    "back end": "backend",
    "back-end": "backend",
    "tailwind css": "tailwind",
}

SYNONYMS = {
    "js": "javascript",
    "ts": "typescript",
    "k8s": "kubernetes",
    "postgres": "postgresql",
    "golang": "go",
    "ml": "machinelearning",
    "node": "nodejs",
    "bengaluru": "bangalore",
    "gurugram": "gurgaon",
    "bombay": "mumbai",
    "wfh": "remote",
    "developer": "engineer",
    "dev": "engineer",
    "programmer": "engineer",
    "devs": "engineer",
    "engineers": "engineer",
    "developers": "engineer",
    "jobs": "job",
    "roles": "role",
    "microservice": "microservices",
    "apis": "api",
}

CONCEPTS = {
    "cloud": ["aws", "azure", "gcp"],
    "backend": ["api", "server", "microservices"],
    "frontend": ["ui", "react", "javascript"],
    "devops": ["cicd", "kubernetes", "docker"],
    "data": ["sql", "pipeline"],
    "ai": ["machinelearning", "llms"],
    "mobile": ["android", "ios"],
    "testing": ["qa", "automation"],
    "fullstack": ["frontend", "backend"],
}

STOPWORDS = [
    "a", "an", "the", "and", "or", "of", "to", "in", "on", "for", "with", "at", "by", "from", "as", "is", "are",
    "be", "this", "that", "it", "its", "we", "you", "our", "your", "i", "im", "me", "my", "will", "have", "has",
    "who", "what", "which", "into", "across", "such", "etc", "can", "do", "does", "find", "show", "want", "looking",
    "need", "please", "any", "some", "all", "am", "also", "about", "using",
]

DIMENSIONS = 1024
TOKEN_WEIGHT = 1.0
CONCEPT_WEIGHT = 0.35
BIGRAM_WEIGHT = 0.5

# ---------------------------------------------------------------------------
# skills
# ---------------------------------------------------------------------------
SKILLS = [
    "Java", "Spring Boot", "Spring Cloud", "Hibernate", "Microservices", "Kafka", "AWS", "Azure", "GCP",
    "Docker", "Kubernetes", "Terraform", "Jenkins", "GitHub Actions", "PostgreSQL", "MySQL", "MongoDB",
    "Redis", "Elasticsearch", "REST APIs", "GraphQL", "JavaScript", "TypeScript", "React", "Next.js",
    "Redux", "Angular", "Vue.js", "HTML", "CSS", "Tailwind CSS", "Node.js", "Express", "NestJS", "Python",
    "Django", "FastAPI", "Flask", "Pandas", "NumPy", "Machine Learning", "Deep Learning", "PyTorch",
    "TensorFlow", "NLP", "LLMs", "Spark", "Airflow", "Snowflake", "SQL", "dbt", "Power BI", "Tableau", "Go",
    "Rust", "C#", ".NET", "Kotlin", "Swift", "Android", "iOS", "Flutter", "React Native", "Selenium",
    "Cypress", "Playwright", "JUnit", "Linux", "Prometheus", "Grafana", "Figma", "Scala", "Salesforce",
    "SAP", "Cybersecurity", "Networking", "Git", "CI/CD", "Agile",
]

SKILL_ALIASES = {
    "Spring Boot": ["springboot", "spring-boot", "spring"],
    "Spring Cloud": ["spring-cloud"],
    "Hibernate": ["jpa"],
    "Microservices": ["microservice", "micro services", "micro-services"],
    "Kafka": ["apache kafka"],
    "AWS": ["amazon web services"],
    "GCP": ["google cloud", "google cloud platform"],
    "Kubernetes": ["k8s"],
    "PostgreSQL": ["postgres", "postgre sql"],
    "MongoDB": ["mongo"],
    "REST APIs": ["rest api", "restful", "rest", "restful apis"],
    "JavaScript": ["js", "ecmascript"],
    "React": ["reactjs", "react.js"],
    "Next.js": ["nextjs"],
    "Vue.js": ["vue", "vuejs"],
    "Tailwind CSS": ["tailwind"],
    "Node.js": ["node", "nodejs", "node js"],
    "Express": ["express.js", "expressjs"],
    "NestJS": ["nest.js", "nest"],
    "Machine Learning": ["ml"],
    "Deep Learning": ["dl"],
    "LLMs": ["llm", "genai", "gen ai", "generative ai", "large language models"],
    "Spark": ["apache spark", "pyspark"],
    "Airflow": ["apache airflow"],
    "Power BI": ["powerbi"],
    "Go": ["golang"],
    "C#": ["csharp", "c sharp"],
    ".NET": ["dotnet", "asp.net", ".net core"],
    "React Native": ["react-native"],
    "Cybersecurity": ["cyber security", "infosec", "security"],
    "CI/CD": ["cicd", "ci cd", "continuous integration"],
    "iOS": ["ios"],
}

# names that are everyday words: only their exact spelling counts
EXACT_CASE_SKILLS = ["Go", "Express", "Swift", "Rust", "Spark", "Flutter", "SAP", "Git"]

# ---------------------------------------------------------------------------
# Locations, in order of precedence (the country comes last)
# ---------------------------------------------------------------------------
LOCATIONS = {
    "Bangalore": ["bangalore", "bengaluru", "blr"],
    "Hyderabad": ["hyderabad", "hyd"],
    "Pune": ["pune"],
    "Chennai": ["chennai", "madras"],
    "Mumbai": ["mumbai", "bombay"],
    "Gurgaon": ["gurgaon", "gurugram"],
    "Noida": ["noida"],
    "Ahmedabad": ["ahmedabad"],
    "Kochi": ["kochi", "cochin"],
    "Kolkata": ["kolkata", "calcutta"],
    "India": ["india"],
}
PLACELESS = ["remote", "anywhere"]

# ---------------------------------------------------------------------------
# Message understanding.  `\b` is spelled as an ASCII look-around
# because its meaning next to accented letters differs between Java versions.
# ---------------------------------------------------------------------------
B_OPEN = r"(?<!\w)"
B_SHUT = r"(?!\w)"

SALARY_AMOUNT = r"(?:₹|rs\.?|inr)?\s*(\d+(?:\.\d+)?)\s*(?:lpa|lakhs?|lacs?|l)(?![a-z])"
SALARY_SPAN = r"(?:₹|rs\.?|inr)?\s*(\d+(?:\.\d+)?)\s*(?:-|to)\s*(?:₹|rs\.?|inr)?\s*(\d+(?:\.\d+)?)\s*(?:lpa|lakhs?|lacs?|l)(?![a-z])"
SALARY_LEAST = r"(?:above|over|more than|greater than|at least|atleast|minimum(?: of)?|min\.?|>=?|upwards of|starting(?: at| from)?|from|(?<!\w)of)\s*(?:₹|rs\.?|inr)?\s*(\d+(?:\.\d+)?)\s*(?:lpa|lakhs?|lacs?|l)(?![a-z])"
SALARY_MOST = r"(?:below|under|less than|up to|upto|at most|maximum(?: of)?|max\.?|<=?)\s*(?:₹|rs\.?|inr)?\s*(\d+(?:\.\d+)?)\s*(?:lpa|lakhs?|lacs?|l)(?![a-z])"
YEARS_SPAN = r"(\d{1,2})\s*(?:-|to)\s*(\d{1,2})\s*\+?\s*(?:years?|yrs?)"
YEARS_LESS = r"(?:less than|under|below|fewer than|<)\s*(\d{1,2})\s*\+?\s*(?:years?|yrs?)"
YEARS_MOST = r"(?:up to|upto|at most|maximum(?: of)?|max\.?)\s*(\d{1,2})\s*\+?\s*(?:years?|yrs?)"
YEARS_MORE = r"(?:more than|over|at least|atleast|minimum(?: of)?|min\.?|above)\s*(\d{1,2})\s*\+?\s*(?:years?|yrs?)"
YEARS_PLUS = r"(\d{1,2})\s*\+\s*(?:years?|yrs?)"
YEARS_EXACT = r"(\d{1,2})\s*(?:years?|yrs?)"
FRESHER_WORDS = "fresher|freshers|entry[- ]level|graduate|no experience"

REMOTE_WORDS = "remote|work from home|wfh|work-from-home|remotely"
ONSITE_WORDS = "on-?site|in-office|in office|office-based|not remote"

# in order of precedence
EMPLOYMENT_WORDS = {
    "INTERNSHIP": "internship|intern|interns",
    "PART_TIME": "part[- ]time",
    "CONTRACT": "contract|contractual|freelance",
    "FULL_TIME": "full[- ]time|permanent",
}
EMPLOYMENT_LABELS = {
    "FULL_TIME": "Full-time",
    "PART_TIME": "Part-time",
    "CONTRACT": "Contract",
    "INTERNSHIP": "Internship",
}

ITEM_IDS = r"(?:#|(?<!\w)job\s*#?\s*|(?<!\w)id\s*)(\d{3,})"
ITEM_POINTED = r"(?<!\w)(?:this|that|the (?:first|second|third|fourth|fifth|last|top)|1st|2nd|3rd|4th|5th)\s+(?:job|role|position|one|opening|listing)(?!\w)|(?<!\w)job\s*#?\s*\d+|#\d+|(?<!\w)(?:it|this one)(?!\w)"
LAST_ITEM = r"(?<!\w)last (?:job|one|role)(?!\w)"
ITEM_NAMED = r"(?<!\w)(?:job|role|one|position)(?!\w)"
FIRST_COUNT = r"(?<!\w)(?:first|top|best)\s+(two|three|four|five|2|3|4|5)(?!\w)"
COMPARE = r"(?<!\w)(?:compar(?:e|ison|ing)|vs\.?|versus|difference between|side by side)(?!\w)"
NUMBER_NOUNS = r"(?:job|jobs|number|no\.?)?"
NUMBER_UNITS = r"\s*(?:years?|yrs?|lpa|lakh|\+|-)"
QUESTION_WORDS = (
    "what|which|does|do|is|are|how|tell me|explain|describe|more about|details|skills|benefits|"
    "requirements|responsibilit|salary|apply|require"
)
REFINE_START = "only|just|and|but|now|also|what about|how about|filter|narrow|exclude|remove|same"
REFINE_ANYWHERE = (
    "those|these|them|of them|among them|from these|from those|from the above|above results|"
    "previous results|same search|the results|the list"
)
SEARCH_WORDS = (
    "jobs?|roles?|positions?|openings?|vacanc|hiring|hire|career|work|opportunit|intern|salary|lpa|ctc|"
    "experience|years?|develop|engineer|programm|design|analyst|architect|manager|lead|consultant|"
    "backend|frontend|full.?stack|devops|sre|cloud|data|mobile|qa|test|security|machine learning|"
    "ml|ai|fintech|startup|company|companies|remote|onsite|hybrid|find|search|show|looking|recommend|"
    "apply|offer"
)
GREETING_WORDS = (
    "hi|hello|hey|hola|namaste|good (?:morning|afternoon|evening)|thanks|thank you|ok|okay|cool|great|"
    "help|who are you|what can you do"
)
ORDINALS = {
    "first": 1, "1st": 1, "second": 2, "2nd": 2, "third": 3, "3rd": 3,
    "fourth": 4, "4th": 4, "fifth": 5, "5th": 5,
}
NUMBER_WORDS = {"two": 2, "three": 3, "four": 4, "five": 5, "2": 2, "3": 3, "4": 4, "5": 5}

NON_TOPIC = [
    "job", "role", "position", "opening", "opportunity", "opportunitie", "vacancy", "vacancie", "work", "remote",
    "hybrid", "onsite", "office", "salary", "lpa", "lakh", "lakhs", "lac", "inr", "rs", "year", "years", "yrs",
    "experience", "exp", "above", "below", "over", "under", "less", "more", "than", "least", "most", "minimum",
    "maximum", "min", "max", "between", "only", "just", "also", "show", "list", "give", "get", "search", "look",
    "compare", "comparison", "versus", "vs", "first", "second", "third", "top", "best", "matching", "match",
    "engineer", "fresher", "india", "city", "location", "based", "full", "time", "part", "contract", "internship",
    "intern", "permanent", "those", "these", "them", "then", "now", "like", "would", "could", "should", "many",
    "much", "new", "good", "great", "hi", "hello", "hey", "thank", "thanks", "ok", "okay", "per", "annum", "month",
    "high", "higher", "paying", "pay", "package", "ctc", "offer", "available", "current", "currently", "id",
    "require", "requiring", "required", "requirement", "skill", "skilled", "knowledge", "background", "someone",
    "people", "plus", "etc", "tell", "know",
]

INTENTS = ["NEW_SEARCH", "REFINE", "COMPARE", "JOB_QUESTION", "GENERAL"]
LAKH = 100_000

# ---------------------------------------------------------------------------
# Ranking, chunking, paging
# ---------------------------------------------------------------------------
WEIGHTS = {
    "semantic": 0.35,
    "skills": 0.25,
    "experience": 0.15,
    "location": 0.10,
    "remote": 0.05,
    "salary": 0.10,
}
RELAXATION_ORDER = ["salary", "experience", "location", "employment type", "remote"]
CHUNK_MAX_CHARS = 900
CHUNKING_VERSION = "sections-v1"
RETRIEVAL_TOP_K = 20
POOL_SIZE = 50
MAX_RETURNED = 5
HISTORY_WINDOW = 8
EMBED_BATCH = 32
SECTIONS = ["OVERVIEW", "SKILLS", "REQUIREMENTS", "RESPONSIBILITIES", "BENEFITS"]
RECENCY_GROUPS = ["Today", "Yesterday", "Previous 7 days", "Previous 30 days", "Older"]

# Why a message was read by the rules alone.
NO_MODEL = "LLM not configured: used rule-based extraction"
BAD_MODEL_OUTPUT = ("LLM extraction output invalid (", "): used rule-based extraction")
