"""Word lists and labels that results depend on."""

# The terms, labels and limits below must be these, in this order, for results to agree.
SKILLS = {
    "py": [
        "python", "matlab", "r", "java", "c++", "c#", "javascript", "typescript", "sql", "julia", "fortran", "labview", "tensorflow", "pytorch",
        "scikit-learn", "pandas", "numpy", "opencv", "ros", "ansys", "comsol", "autocad", "solidworks",
    ],
    "js": [
        "python", "matlab", "r", "java", "c++", "javascript", "sql", "julia", "tensorflow", "pytorch", "scikit-learn", "pandas", "numpy", "ros", "ansys",
        "comsol", "autocad", "solidworks", "labview", "opencv",
    ],
}
TECHNIQUES = {
    "py": ["sem", "tem", "xrd", "ftir", "nmr", "pcr", "hplc", "gc-ms", "electrochemistry", "cell culture", "microscopy", "spectroscopy", "chromatography", "flow cytometry", "raman", "afm"],
    "js": ["sem", "tem", "xrd", "ftir", "nmr", "pcr", "hplc", "gc-ms", "electrochemistry", "cell culture", "microscopy", "spectroscopy", "raman", "afm"],
}
THEMES = {
    "py": {
        "machine learning": ["neural", "deep learning", "machine learning", "nlp", "ai", "transformer"],
        "robotics": ["robot", "control system", "autonomous", "drone", "manipulation"],
        "energy storage": ["battery", "fuel cell", "supercapacitor", "electrode", "electrolyte"],
        "materials science": ["material", "polymer", "alloy", "composite", "thin film", "nanomaterial"],
        "biomedical engineering": ["biomedical", "tissue", "implant", "drug delivery", "cell", "clinical"],
        "sustainability": ["sustainability", "renewable", "carbon", "co2", "climate", "green"],
        "fluid dynamics": ["fluid", "cfd", "turbulence", "flow", "aerodynamics"],
        "semiconductors": ["semiconductor", "transistor", "cmos", "ic design", "photovoltaic"],
        "computational methods": ["simulation", "finite element", "molecular dynamics", "modeling"],
    },
    "js": {
        "machine learning": ["neural", "deep learning", "machine learning", "nlp", "ai"],
        "robotics": ["robot", "autonomous", "drone", "manipulation"],
        "energy storage": ["battery", "fuel cell", "supercapacitor", "electrode"],
        "materials science": ["material", "polymer", "alloy", "composite", "nanomaterial"],
        "biomedical engineering": ["biomedical", "tissue", "implant", "drug delivery"],
        "sustainability": ["sustainability", "renewable", "carbon", "co2", "climate"],
        "fluid dynamics": ["fluid", "cfd", "turbulence", "aerodynamics"],
        "semiconductors": ["semiconductor", "transistor", "cmos", "photovoltaic"],
        "computational methods": ["simulation", "finite element", "molecular dynamics"],
    },
}
YEARS = {
    "py": {"freshman": "Freshman", "sophomore": "Sophomore", "junior": "Junior", "senior": "Senior", "graduate": "Graduate", "ph.d": "Ph.D", "phd": "Phd", "master": "Master"},
    "js": {"freshman": "Freshman", "sophomore": "Sophomore", "junior": "Junior", "senior": "Senior", "graduate": "Graduate", "phd": "Phd", "master": "Master"},
}
MAJORS = {
    "py": [
        "chemical engineering", "mechanical engineering", "electrical engineering", "computer science", "materials science", "civil engineering",
        "biomedical engineering", "aerospace engineering", "industrial engineering",
    ],
    "js": ["chemical engineering", "mechanical engineering", "electrical engineering", "computer science", "materials science", "civil engineering", "biomedical engineering"],
}
GENERIC_TOPICS = ["materials", "energy", "inorganic", "organic", "physical", "analytical", "modeling", "theory", "design", "systems", "control", "imaging", "synthesis", "analysis", "simulation"]
SMALL_WORDS = ["a", "an", "the", "and", "but", "or", "for", "nor", "on", "at", "to", "by", "of", "in", "with"]
STATUSES = ["Not Started", "Drafting Email", "Applied", "Follow Up Sent", "Interview Scheduled", "Accepted", "Rejected", "Closed"]
CSV_HEADERS = ["Professor Name", "Lab Name", "Department", "Research Area", "Status", "Date Applied", "Follow-Up Date", "Email Used", "Notes", "Source Link", "Last Updated"]
CSV_FIELDS = ["professorName", "labName", "department", "researchArea", "status", "dateApplied", "followUpDate", "emailUsed", "notes", "sourceLink", "lastUpdated"]
PROFILE_FIELDS = [
    "id", "name", "title", "department", "email", "profile_url", "lab_website", "research_summary", "google_scholar", "ai_review", "photo_url", "phone",
    "office", "scholar_interests", "publications",
]
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
FILLER = [
    r"Research\s+Research\s*", r"Research\s+Facilities\s+and\s+Equipment\s*", r"Faculty\s+Research\s+Specialty\s+Areas?\s*", r"Undergraduate\s+Research\s*",
    r"Seminars?\s+and\s+Distinguished\s+Lectures?\s*", r"Research\s+Areas?\s*", r"Close the\s+\w[\w\s&]*menu\.?", r"(Research|Instructional|Emeritus)\s+Faculty\s*",
    r"Joint\s+Appointments?\s*", r"Chemistry\s+Facilities\s*", r"Centers?\s+and\s+Institutes?\s*", r"Faculty\s+&\s+Research\s*", r"People\s+Directory\s*", r"Faculty\s+Directory\s*",
]
HEADING_TOPIC = r"^(Research|Faculty|Labs?|Seminars?|Home|About|Contact|People|Close|Directory)\s*$"
MENU_TOPIC = r"(Close the|menu\b|Directory|Faculty\s+&)"
#: Display names of departments by style.
DEPARTMENTS = {
    "search": {
        "aerospace": "Aerospace Engineering", "biomedical": "Biomedical Engineering", "chemical": "Chemical Engineering", "civil": "Civil & Environmental", "cse": "Computer Science & Eng.",
        "electrical": "Electrical & Computer Eng.", "etid": "Engineering Technology", "industrial": "Industrial & Systems", "materials": "Materials Science", "mechanical": "Mechanical Engineering",
        "multidisciplinary": "Multidisciplinary Eng.", "nuclear": "Nuclear Engineering", "ocean": "Ocean Engineering", "petroleum": "Petroleum Engineering", "biology": "Biology", "chemistry": "Chemistry",
        "mathematics": "Mathematics", "physics-astronomy": "Physics & Astronomy", "statistics": "Statistics", "atmos-science": "Atmospheric Sciences", "geology-geophysics": "Geology & Geophysics",
        "oceanography": "Oceanography", "psychological-brain-sciences": "Psych. & Brain Sciences",
    },
    "match": {
        "chemical": "Chemical Engineering", "mechanical": "Mechanical Engineering", "cse": "Computer Science", "electrical": "Electrical Engineering", "materials": "Materials Science",
        "civil": "Civil Engineering", "nuclear": "Nuclear Engineering", "industrial": "Industrial Engineering", "ocean": "Ocean Engineering", "petroleum": "Petroleum Engineering",
    },
    "review": {
        "aerospace": "Aerospace Engineering", "biomedical": "Biomedical Engineering", "chemical": "Chemical Engineering", "civil": "Civil & Environmental Engineering", "cse": "Computer Science & Engineering",
        "electrical": "Electrical & Computer Engineering", "etid": "Engineering Technology & Industrial Distribution", "industrial": "Industrial & Systems Engineering", "materials": "Materials Science & Engineering",
        "mechanical": "Mechanical Engineering", "nuclear": "Nuclear Engineering", "ocean": "Ocean Engineering", "petroleum": "Petroleum Engineering", "biology": "Biology", "chemistry": "Chemistry",
        "mathematics": "Mathematics", "physics-astronomy": "Physics & Astronomy", "statistics": "Statistics", "oceanography": "Oceanography", "psychological-brain-sciences": "Psychological & Brain Sciences",
    },
    "tracker": {
        "aerospace": "Aerospace", "biomedical": "Biomedical", "chemical": "Chemical", "civil": "Civil", "cse": "Computer Science", "electrical": "Electrical", "etid": "Eng. Technology",
        "industrial": "Industrial", "materials": "Materials", "mechanical": "Mechanical", "multidisciplinary": "Multidisciplinary", "nuclear": "Nuclear", "ocean": "Ocean", "petroleum": "Petroleum",
        "biology": "Biology", "chemistry": "Chemistry", "mathematics": "Mathematics", "physics-astronomy": "Physics & Astronomy", "statistics": "Statistics", "atmos-science": "Atmospheric Science",
        "geology-geophysics": "Geology & Geophysics", "oceanography": "Oceanography", "psychological-brain-sciences": "Psych & Brain Sciences",
    },
}
