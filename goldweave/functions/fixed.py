"""Fixed values that results depend on: vocabularies, alias tables, patterns, weights.

Everything here is data, stated as text in its natural order.
"""

from __future__ import annotations


#: Country code and the spellings that mean it.
COUNTRIES = {
    "US": ["united states", "usa", "us", "u.s.", "u.s.a.", "america"],
    "IN": ["india", "in", "bharat"],
    "GB": ["united kingdom", "uk", "gb", "great britain", "england"],
    "CA": ["canada", "ca"],
    "DE": ["germany", "de", "deutschland"],
    "FR": ["france", "fr"],
    "AU": ["australia", "au"],
    "SG": ["singapore", "sg"],
    "JP": ["japan", "jp"],
    "CN": ["china", "cn"],
    "BR": ["brazil", "br"],
    "NL": ["netherlands", "nl", "holland"],
    "SE": ["sweden", "se"],
    "CH": ["switzerland", "ch"],
    "KR": ["south korea", "kr", "korea"],
    "IL": ["israel", "il"],
    "AE": ["uae", "ae", "united arab emirates"],
    "NZ": ["new zealand", "nz"],
    "IE": ["ireland", "ie"],
    "ES": ["spain", "es"],
    "IT": ["italy", "it"],
    "MX": ["mexico", "mx"],
    "RU": ["russia", "ru"],
    "ZA": ["south africa", "za"],
}

#: Skill and the spellings that mean it.
SKILLS = {
    "JavaScript": ["js", "javascript", "java script", "es6", "ecmascript"],
    "Python": ["py", "python", "python3", "py3"],
    "TypeScript": ["ts", "typescript", "type script"],
    "C++": ["c++", "cpp"],
    "C#": ["c#", "csharp", "c sharp"],
    "AWS": ["aws", "amazon web services"],
    "GCP": ["gcp", "google cloud", "google cloud platform"],
    "Azure": ["azure", "microsoft azure"],
    "Machine Learning": ["ml", "machinelearning", "machine learning"],
    "Deep Learning": ["dl", "deeplearning", "deep learning"],
    "NLP": ["nlp", "natural language processing"],
    "Artificial Intelligence": ["ai", "artificial intelligence"],
    "Computer Vision": ["cv", "computer vision"],
    "Docker": ["docker", "docker-compose"],
    "Kubernetes": ["k8s", "kubernetes"],
    "CI/CD": ["ci/cd", "cicd", "ci cd"],
    "PostgreSQL": ["postgres", "postgresql"],
    "MongoDB": ["mongo", "mongodb"],
    "MySQL": ["mysql", "my sql"],
    "Redis": ["redis"],
    "NoSQL": ["nosql", "no sql"],
    "SQL": ["sql"],
    "React": ["react", "reactjs", "react.js"],
    "Angular": ["angular", "angularjs"],
    "Vue.js": ["vue", "vuejs", "vue.js"],
    "Next.js": ["nextjs", "next.js"],
    "Node.js": ["node", "nodejs", "node.js"],
    "Django": ["django"],
    "Flask": ["flask"],
    "FastAPI": ["fastapi", "fast api"],
    "Spring": ["spring"],
    "Spring Boot": ["spring boot", "springboot"],
    "Git": ["git"],
    "GitHub": ["github"],
    "HTML": ["html", "html5"],
    "CSS": ["css", "css3"],
    "REST API": ["rest", "restful", "rest api"],
    "GraphQL": ["graphql", "graph ql"],
    "Go": ["golang", "go"],
    "Rust": ["rust"],
    "Java": ["java"],
    "Scala": ["scala"],
    "Ruby": ["ruby"],
    "R": ["r"],
    "Swift": ["swift"],
    "Kotlin": ["kotlin"],
    "Terraform": ["terraform"],
    "Ansible": ["ansible"],
    "Pandas": ["pandas"],
    "NumPy": ["numpy"],
    "TensorFlow": ["tensorflow", "tf"],
    "PyTorch": ["pytorch"],
    "Scikit-learn": ["scikit-learn", "sklearn"],
    "Tableau": ["tableau"],
    "Power BI": ["power bi", "powerbi"],
    "Agile": ["agile"],
    "Scrum": ["scrum"],
}

#: Terms that the text scan looks for, in its order, and those not written in title case.
SCANNED_SKILLS = ["python", "java", "javascript", "typescript", "c++", "c#", "rust", "go", "html", "css", "sql", "nosql", "postgresql", "mysql", "mongodb", "redis", "fastapi", "django", "flask", "react", "next.js", "angular", "vue", "docker", "kubernetes", "aws", "gcp", "azure", "ci/cd", "git", "machine learning", "deep learning", "nlp", "computer vision", "yolo", "data science", "pandas", "numpy", "tensorflow", "pytorch", "faiss"]
SKILL_CASES = {"next.js": "Next.js", "c++": "C++", "c#": "C#", "ci/cd": "CI/CD", "nlp": "NLP", "aws": "AWS", "gcp": "GCP", "yolo": "YOLO", "faiss": "FAISS"}

#: Mail providers whose domains are no portfolios.
MAIL_PROVIDERS = ["gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "icloud.com", "protonmail.com", "live.com", "msn.com", "ymail.com", "rediffmail.com", "aol.com", "zoho.com"]

#: Cities with a known country; second parts of a place that are countries; whole phrases.
CITIES = {"chennai": "IN", "bengaluru": "IN", "bangalore": "IN", "hyderabad": "IN", "pune": "IN", "mumbai": "IN", "delhi": "IN", "san francisco": "US", "new york": "US", "london": "GB"}
COUNTRY_WORDS = ["india", "usa", "united states", "uk", "united kingdom", "us", "in", "gb"]
PLACES = {"Bengaluru, Karnataka, India": ("Bengaluru", "Karnataka", "India"), "Chennai, Tamil Nadu": ("Chennai", "Tamil Nadu", "IN"), "Pune, Maharashtra": ("Pune", "Maharashtra", "IN")}

#: Words that mean no end date; months; made-up phone numbers.
OPEN_ENDED = ["present", "current", "now", "ongoing", "active"]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
FAKE_PHONES = ["1234567890", "0123456789", "9876543210"]
UNKNOWN_NAME, UNKNOWN_COMPANY, UNKNOWN_TITLE, UNKNOWN_SCHOOL = "Unknown Candidate", "Unknown Company", "Unknown Title", "Unknown Institution"

#: Patterns of extraction.
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
SPACED_EMAIL = r"([a-zA-Z0-9._%+-]+)\s*@\s*([a-zA-Z0-9.-]+)\s*\.\s*([a-zA-Z]{2,})"
PHONE = r"\+?\(?[0-9]{1,4}\)?[-.\s]?\(?[0-9]{1,3}\)?[-.\s]?[0-9]{3,5}[-.\s]?[0-9]{3,5}"
LINKEDIN = r"(?i)(?:https?://)?(?:www\.)?linkedin\.com/in/[a-zA-Z0-9_-]+"
GITHUB = r"(?i)(?:https?://)?(?:www\.)?github\.com/[a-zA-Z0-9_-]+"
URL, DOMAIN = r"(?:https?://)[^\s]+", r"\b[a-zA-Z0-9.-]+\.(?:com|org|net|io|me)\b"
PORTFOLIO = r"(?:https?://)?(?:www\.)?[a-zA-Z0-9_-]+\.(?:com|org|net|io|me)"
NAME_LABEL = r"(?i)(?:Candidate|Name)\s*:\s*([^\n\r]+)"
HONORIFICS = r"(?iU)\b(?:Mr|Dr|Mrs|Ms|Prof|Ph\.?D|Jr|Sr|III|II|IV)\b\.?"
HEADLINE = r"(?is)(?:Summary|About\s*Me|Bio|Profile)\s*\n+(.+?)(?=\n\s*(?:Experience|Work|Education|Skills|\d))"
WORK_SECTION = r"(?is)(?:Experience|Work\s*History|Employment\s*History)\s*\n+(.+?)(?=\n\s*(?:Education|Skills|Projects|Certifications|$))"
STUDY_SECTION = r"(?is)(?:Education|Academic\s*History|University|College)\s*\n+(.+?)(?=\n\s*(?:Experience|Work|Skills|Projects|Certifications|$))"
LOCATIONS = [
    r"(?i)Location\s*:\s*([A-Za-z]+(?:[\s-][A-Za-z]+)*(?:,\s*[A-Za-z]+(?:[\s-][A-Za-z]+)*){0,2})",
    r"(?i)(?:Currently\s+)?(?:Based|living|Lives)\s+in\s+([A-Z][a-zA-Z]+(?:[\s-][A-Z][a-zA-Z]+)*(?:,\s*[A-Z][a-zA-Z]+(?:[\s-][A-Z][a-zA-Z]+)*){0,2})",
    r"(?i)\bfrom\s+([A-Z][a-zA-Z]+(?:[\s-][A-Z][a-zA-Z]+)*(?:,\s*[A-Z][a-zA-Z]+(?:[\s-][A-Z][a-zA-Z]+)*){1,2})",
]
JOB_SPLIT = r"\s+at\s+|\s*\|\s*|\s*-\s*|\s*,\s*"
JOB_DATES = r"(?i)([A-Za-z]+ \d{4}|\d{4}-\d{2}|\d{2}/\d{4})\s*(?:-|to)\s*(Present|Current|[A-Za-z]+ \d{4}|\d{4}-\d{2}|\d{2}/\d{4})"
DEGREE_START = r"(?i)^(?:B\.?E\.?|B\.?S\.?|B\.?Tech|M\.?S\.?|M\.?Tech|Ph\.?D|Bachelor|Master|Degree)\b"
DEGREE = r"B\.?S\.?|M\.?S\.?|B\.?E\.?|B\.?Tech|Ph\.?D|Bachelor|Master|Degree"
SCHOOL_WORDS = ["university", "college", "school", "institute", "academy", "polytechnic"]
STUDY_FIELD = r"(?i)(?:in|major in|of)\s+([A-Za-z\s]{3,30})"
STUDY_DATES = r"(?i)\b(19\d{2}|20\d{2}|present|current|ongoing|now)\b"

#: Trust in sources, extraction confidences, matching and quality weights.
PRIORITIES = {"recruiter_notes.txt": 30, "ats_profile.json": 20, "recruiter_export.csv": 20, "resume.docx": 10, "resume.pdf": 10}
DEFAULT_PRIORITY, STRUCTURED_CONFIDENCE, TEXT_CONFIDENCE = 10, 1.0, 0.6
NAME_WEIGHT, COMPANY_WEIGHT, CONFIRMED, PROBABLE = 0.6, 0.4, 0.85, 0.65
EXPECTED = ["Full Name", "Email", "Phone", "Location", "Headline / Summary", "Years Experience", "Skills", "Work Experience", "Education", "LinkedIn", "GitHub", "Portfolio"]

#: What reports say, with {} for what they name.
ADVISORIES = ["Expected Salary", "Notice Period", "Current Employment Status", "Work Authorization", "Preferred Location"]
ADVICE = {
    "missing": "Add the following fields to improve profile completeness: {}.",
    "LinkedIn": "A LinkedIn URL significantly improves recruiter confidence.",
    "Headline / Summary": "A professional headline / summary improves searchability.",
    "Work Experience": "No work experience was extracted — verify source documents.",
    "Skills": "No skills were extracted — verify source documents.",
    "advisory": "Consider adding: {} (not in current sources).",
}
EXPLANATIONS = {
    "none": ["Single source — no conflict resolution required."],
    "single_source": ["Only one source provided this field — no conflict resolution required."],
    "source_priority": ["Source priority comparison: {}", "Higher priority sources override lower priority ones for this field."],
    "confidence": ["Extraction confidence comparison: {}", "Higher confidence extractions are preferred when source priority is equal."],
    "recency": ["Source priority and confidence were equal.", "The more recently processed source was selected as the tie-breaker."],
}
WARNINGS = {
    "dates": "Validation Warning: Job at '{}' has end_date before start_date ({} < {}).",
    "years": "Validation Warning: Candidate has negative years of experience.",
    "future": "Validation Warning: Education institution '{}' has graduation year ({}) in the far future.",
    "contact": "Validation Warning: Candidate profile has no contact information (emails and phones are empty).",
    "fuzzy": "Validation Warning: Resolved duplicate candidate via probable fuzzy matching (score: {}). Manual review recommended.",
}
REASONS = {
    "source_priority": "Source priority ({}: {}) > ({}: {})",
    "confidence": "Confidence ({}) > ({})",
    "newer": "Recency tie-breaker (incoming newer)",
    "older": "Recency tie-breaker (current newer)",
    "single": "Single source populated",
    "initial": "Initial profile value",
    "list": "Resolved by priority, confidence and recency",
}

#: How conflicts, explanations and reports name fields and sections.
CONFLICT_FIELDS = {"city": "location.city", "region": "location.region", "country": "location.country", "linkedin": "links.linkedin", "github": "links.github", "portfolio": "links.portfolio"}
FIELD_LABELS = {"full_name": "Full Name", "headline": "Headline / Summary", "years_experience": "Years Experience", "city": "Location — City", "region": "Location — Region", "country": "Location — Country", "linkedin": "LinkedIn URL", "github": "GitHub URL", "portfolio": "Portfolio URL", "emails": "Email", "phones": "Phone"}
REPORT = {"overview": "Canonical Candidate Profile Golden Record Overview", "contact": "Contact Information & Digital Profiles", "summary": "Professional Summary", "skills": "Canonical Skills", "experience": "Professional Experience", "education": "Academic Qualifications", "provenance": "Field Ingestion Provenance Trace", "warnings": "Pipeline Integrity Warnings", "metadata": "Ingestion Report Metadata"}
REPORT_EMPTY = {"summary": "No professional summary provided.", "experience": "No employment experience registered.", "education": "No education history registered.", "warnings": "✓ Ingestion validation succeeded. No integrity conflicts detected.", "reason": "Source priority map tie-breaker"}
VALIDATION_RULES = 5
