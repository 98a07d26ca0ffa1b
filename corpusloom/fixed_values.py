"""Word lists, patterns, thresholds and message texts that results depend on.

Nothing here is logic.  Every list is in its natural order because ties are
broken by list position.  All of them are defaults; the operators take
replacements as parameters.  Patterns made of word lists (CONTENT_PATTERNS,
CONCEPT_LEADS, CLAIM_PHRASES) are kept as words, since the SQL twins need the words.
"""

# --- fixed values: intake -----------------------------------------------------
SUPPORTED_EXTENSIONS = [".pdf", ".txt", ".docx", ".epub", ".md"]
SUPPORTED_MIME_TYPES = [
    "application/pdf", "text/plain", "text/markdown",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
]
MAX_FILE_BYTES = 50_000_000
MAX_INTAKE_MB = 100
MAX_INTAKE_PAGES = 200

# --- fixed values: cleaning ---------------------------------------------------
MIN_TEXT_LENGTH = 10
HEADER_WORDS = ["chapter", "page", "copyright", "©", "all rights reserved"]
SCRIPT_PATTERNS = [
    r"(?i)<script[^>]*>.*?</script>", r"(?i)javascript:", r"(?i)data:text/html", r"(?i)vbscript:",
]

# --- fixed values: quality weights and thresholds -----------------------------
QUALITY_WEIGHTS = {
    "size": 0.15, "coherence": 0.25, "dialogue_potential": 0.20,
    "readability": 0.15, "sentence_variety": 0.10, "vocabulary_diversity": 0.15,
}
MIN_CHUNK_WORDS = 20
MAX_CHUNK_WORDS = 1000
MIN_COHERENCE = 0.5
MIN_DIALOGUE = 0.3
MIN_READABILITY = 30
MAX_READABILITY = 90
MIN_VARIETY = 0.4
MIN_VOCABULARY = 0.3
QUALITY_GRADES = [
    (0.9, "Excellent"), (0.8, "Very Good"), (0.7, "Good"), (0.6, "Fair"), (0.5, "Poor"),
]
LOWEST_GRADE = "Very Poor"
AUTO_APPROVE_AT = 0.7
MANUAL_REVIEW_AT = 0.4

# --- fixed values: cue words --------------------------------------------------
SPEECH_VERBS = ["said", "asked", "replied", "answered", "explained", "stated", "declared"]
SPEECH_PRONOUNS = ["he", "she", "they", "i", "you"]
SHORT_SPEECH_VERBS = ["said", "asked", "replied"]
QUESTION_WORDS = ["what", "how", "why", "when", "where", "who"]
RESPONSE_WORDS = ["yes", "no", "okay", "alright", "sure"]
COHERENCE_CUES = [
    "however", "therefore", "furthermore", "moreover", "additionally", "consequently",
    "meanwhile", "nevertheless", "thus", "hence", "first", "second", "finally", "next",
    "then", "also", "because",
]
TRANSITION_PHRASES = [
    "however", "therefore", "furthermore", "moreover", "additionally", "consequently",
    "meanwhile", "similarly", "in contrast", "for example", "specifically",
    "in particular", "as a result", "on the other hand",
]
SEMANTIC_BOUNDARY_WORDS = [
    "however", "meanwhile", "furthermore", "moreover", "in addition", "on the other hand",
    "in contrast", "nevertheless", "therefore", "consequently", "as a result",
    "in conclusion", "finally", "first", "second", "third", "next", "then", "later",
    "chapter", "section", "part",
]
FLOW_WORDS = {
    "temporal": ["then", "next", "after", "before", "while", "during", "meanwhile"],
    "causal": ["because", "therefore", "consequently", "as a result", "due to"],
    "contrast": ["however", "but", "nevertheless", "on the other hand", "despite"],
    "addition": ["furthermore", "moreover", "in addition", "also", "besides"],
    "conclusion": ["finally", "in conclusion", "to summarize", "therefore", "thus"],
}
CONTEXT_WORDS = {
    "temporal": ["when", "after", "before", "during", "while", "since", "until"],
    "causal": ["because", "since", "therefore", "thus", "consequently", "as a result"],
    "comparative": ["however", "but", "although", "whereas", "on the other hand"],
    "emphasis": ["indeed", "certainly", "definitely", "absolutely", "particularly"],
    "transition": ["furthermore", "moreover", "additionally", "meanwhile", "finally"],
}
DISCOURSE_WORDS = [
    "however", "therefore", "furthermore", "moreover", "consequently", "nevertheless",
    "meanwhile", "subsequently", "additionally",
]
DIALOGUE_VERBS = ["said", "asked", "replied", "answered", "explained", "stated"]
POSITIVE_WORDS = ["good", "great", "excellent", "wonderful", "amazing", "love", "like", "enjoy"]
NEGATIVE_WORDS = ["bad", "terrible", "awful", "hate", "dislike", "horrible", "worst"]
INTRO_WORDS = ["introduction", "begin", "start", "first"]
CONCLUSION_WORDS = ["conclusion", "summary", "finally", "in conclusion"]
EXAMPLE_WORDS = ["example", "for instance", "such as", "specifically"]

# --- fixed values: content type word groups (list order breaks ties) ----------
# kind "quote" = a regular expression; "words" = whole words or phrases;
# "span" = first group of words followed on the same line by a word of the second.
CONTENT_PATTERNS = {
    "dialogue": [
        ("quote", r'"[^"]*"'), ("quote", r"'[^']*'"),
        ("words", ["said", "asked", "replied", "answered", "whispered", "shouted"]),
        ("words", ["he said", "she said", "they said"]),
    ],
    "description": [
        ("span", (["looked", "appeared", "seemed", "was", "were"], ["like", "as"])),
        ("words", ["tall", "short", "beautiful", "ugly", "old", "young", "large", "small"]),
        ("words", ["color", "colour", "shape", "size", "texture"]),
    ],
    "exposition": [
        ("words", ["because", "therefore", "however", "moreover", "furthermore"]),
        ("words", ["first", "second", "third", "finally", "in conclusion"]),
        ("words", ["according to", "research shows", "studies indicate"]),
    ],
    "narrative": [
        ("words", ["then", "next", "after", "before", "while", "during"]),
        ("words", ["suddenly", "immediately", "gradually", "slowly"]),
        ("words", ["happened", "occurred", "took place", "began", "ended"]),
    ],
}

# --- fixed values: themes, concepts, entities, tones --------------------------
THEME_KEYWORDS = {
    "consciousness": ["awareness", "consciousness", "mindfulness", "perception", "cognition"],
    "identity": ["self", "identity", "ego", "personality", "character"],
    "relationships": ["relationship", "connection", "bond", "interaction", "communication"],
    "growth": ["development", "growth", "evolution", "progress", "transformation"],
    "conflict": ["conflict", "struggle", "tension", "opposition", "challenge"],
    "resolution": ["resolution", "solution", "answer", "conclusion", "outcome"],
    "emotion": ["emotion", "feeling", "sentiment", "mood", "passion"],
    "knowledge": ["knowledge", "learning", "understanding", "wisdom", "insight"],
    "power": ["power", "control", "authority", "influence", "dominance"],
    "freedom": ["freedom", "liberty", "independence", "autonomy", "choice"],
}
CONCEPT_LEADS = [
    (["concept", "idea", "principle", "theory", "notion", "belief"], ["of"]),
    (["understanding", "knowledge", "awareness"], ["of", "about"]),
    (["philosophy", "approach", "method", "strategy"], ["of", "for"]),
    (["nature", "essence", "core", "heart"], ["of"]),
]
ORG_WORDS = ["Inc", "Corp", "Ltd", "Company", "Organization"]
PLACE_WORDS = ["City", "State", "Country"]
ENTITY_LABEL_ORDER = ["PERSON", "ORG", "GPE", "EVENT", "WORK_OF_ART", "LAW", "LANGUAGE"]
TONE_KEYWORDS = {
    "zen_buddhism": ["mindfulness", "awareness", "present", "meditation", "compassion"],
    "advaita_vedanta": ["consciousness", "awareness", "self", "reality", "truth"],
    "christian_mysticism": ["divine", "sacred", "prayer", "contemplation", "grace"],
    "sufi_mysticism": ["heart", "love", "divine", "soul", "spiritual"],
    "mindfulness_meditation": ["present", "awareness", "attention", "mindful", "breath"],
    "universal_wisdom": ["wisdom", "understanding", "truth", "insight", "knowledge"],
}
EXAMPLE_KEYWORDS = [
    "consciousness", "awareness", "meditation", "truth", "reality", "being", "self", "ego",
    "love", "compassion", "wisdom", "enlightenment", "awakening", "mindfulness", "presence",
]
QA_KEYWORDS = [
    "consciousness", "awareness", "meditation", "spiritual", "enlightenment", "wisdom",
    "truth", "being", "presence", "mindfulness", "soul", "divine",
]
MONOLOGUE_KEYWORDS = QA_KEYWORDS + ["peace", "love", "compassion", "understanding", "realization"]
ANSWER_LINK_WORDS = ["because", "therefore", "however", "thus"]
COMPLEX_LINK_WORDS = ["therefore", "however", "moreover", "furthermore"]
PARAGRAPH_QUESTIONS = [
    (["consciousness", "awareness", "being"], "What is the nature of consciousness and awareness?"),
    (["meditation", "practice", "mindfulness"], "How should one approach spiritual practice?"),
    (["truth", "reality", "existence"], "What is the ultimate truth or reality?"),
    (["self", "ego", "identity"], "What is the nature of the self?"),
    (["love", "compassion", "heart"], "How does love and compassion manifest in spiritual life?"),
    (["suffering", "pain", "difficulty"], "How should one understand and work with suffering?"),
    (["enlightenment", "awakening", "realization"], "What is the nature of spiritual awakening?"),
    (["god", "divine", "sacred"], "How does one relate to the divine or sacred?"),
]
DEFAULT_PARAGRAPH_QUESTION = "Can you explain this spiritual teaching?"

# --- fixed values: question and answer patterns -------------------------------
STRUCTURED_QA_PATTERNS = [
    r"Q[:\-]\s*(.+?)\s*A[:\-]\s*(.+?)(?=Q[:\-]|$)",
    r"Question[:\-]\s*(.+?)\s*Answer[:\-]\s*(.+?)(?=Question[:\-]|$)",
    r"(?:Questioner|Student|Seeker)[:\-]\s*(.+?)\s*(?:Teacher|Master|Guru)[:\-]\s*(.+?)(?=(?:Questioner|Student|Seeker)[:\-]|$)",
    r"\d+\.\s*Q[:\-]\s*(.+?)\s*A[:\-]\s*(.+?)(?=\d+\.\s*Q[:\-]|$)",
]
# (pattern, question group, answer group), in order of precedence
QA_SEGMENT_PATTERNS = [
    (r"Q[:\-]\s*(.+?)\nA[:\-]\s*(.+?)(?=\n\n|\nQ[:\-]|$)", 1, 2),
    (r"Question[:\-]\s*(.+?)\nAnswer[:\-]\s*(.+?)(?=\n\n|\nQuestion[:\-]|$)", 1, 2),
    (r"Q\d+[:\-]\s*(.+?)\nA\d+[:\-]\s*(.+?)(?=\n\n|\nQ\d+[:\-]|$)", 1, 2),
    (r"Interviewer[:\-]\s*(.+?)\n(?:Guest|Interviewee)[:\-]\s*(.+?)(?=\n\n|\nInterviewer[:\-]|$)", 1, 2),
    (r"Host[:\-]\s*(.+?)\nGuest[:\-]\s*(.+?)(?=\n\n|\nHost[:\-]|$)", 1, 2),
    (r"([A-Z][a-z]+)[:\-]\s*(.+?)\n([A-Z][a-z]+)[:\-]\s*(.+?)(?=\n\n|\n[A-Z][a-z]+[:\-]|$)", 2, 4),
    (r"Student[:\-]\s*(.+?)\n(?:Teacher|Master|Guru)[:\-]\s*(.+?)(?=\n\n|\nStudent[:\-]|$)", 1, 2),
    (r"Seeker[:\-]\s*(.+?)\n(?:Teacher|Master|Sage)[:\-]\s*(.+?)(?=\n\n|\nSeeker[:\-]|$)", 1, 2),
    (r"(.+\?)\s*\n\n(.+?)(?=\n\n.+\?|\n\n[A-Z]|$)", 1, 2),
    (r"(\d+\.\s*.+\?)\s*\n(.+?)(?=\n\d+\.\s*|\n\n|$)", 1, 2),
]
QUESTION_SPEAKERS = ["question", "student", "seeker", "visitor"]
ANSWER_SPEAKERS = ["teacher", "master", "guru", "answer"]
MIN_SEGMENT = 20
MAX_SEGMENT = 2000
QA_RATIO_AT = 0.3

# --- fixed values: pair assessment --------------------------------------------
PAIR_SIMILARITY_MIN = 0.75
PAIR_RATIO_MAX = 1.8
PAIR_RATIO_MIN = 0.5
PAIR_HALLUCINATION_MAX = 0.3
PAIR_OVERALL_MIN = 0.7
PAIR_RATIO_BEST = 1.35
CLAIM_PHRASES = [
    ["studies show", "research indicates", "scientists found", "proven that"],
    [r"\d+%", r"\d+ percent", "statistics show"],
    ["according to", "based on research", "evidence suggests"],
]

# --- fixed values: languages --------------------------------------------------
LANGUAGES = [  # code, name, family, script, has a processing model
    ("en", "English", "Germanic", "Latin", True), ("es", "Spanish", "Romance", "Latin", True),
    ("fr", "French", "Romance", "Latin", True), ("de", "German", "Germanic", "Latin", True),
    ("it", "Italian", "Romance", "Latin", True), ("pt", "Portuguese", "Romance", "Latin", True),
    ("nl", "Dutch", "Germanic", "Latin", True), ("zh", "Chinese", "Sino-Tibetan", "Chinese", True),
    ("ja", "Japanese", "Japonic", "Japanese", True), ("ru", "Russian", "Slavic", "Cyrillic", True),
    ("ar", "Arabic", "Semitic", "Arabic", False), ("hi", "Hindi", "Indo-Aryan", "Devanagari", False),
    ("ko", "Korean", "Koreanic", "Hangul", False),
]

# --- fixed values: refinements ------------------------------------------------
REFINEMENTS = [  # type, base gain, description
    ("improve_clarity", 0.15, "Improved clarity and readability"),
    ("enhance_engagement", 0.20, "Enhanced engagement and interest"),
    ("fix_grammar_style", 0.10, "Fixed grammar and improved style"),
    ("adjust_tone", 0.12, "Adjusted tone and voice"),
    ("simplify_language", 0.18, "Simplified language and vocabulary"),
    ("add_examples", 0.25, "Added examples and illustrations"),
    ("increase_detail", 0.30, "Increased depth and detail"),
    ("custom_refinement", 0.15, "Applied custom refinement"),
]

# --- fixed values: error classes (first match wins) ---------------------------
ERROR_CLASSES = [  # category, severity, message keywords
    ("network", "medium", ["connection", "network", "timeout", "dns", "socket"]),
    ("api", "medium", ["api", "http", "request", "response", "401", "403", "429", "500", "502", "503"]),
    ("file_io", "low", ["file", "directory", "permission", "not found", "access denied"]),
    ("memory", "high", ["memory", "out of memory", "memoryerror"]),
    ("timeout", "medium", ["timeout", "timed out", "timeouterror"]),
    ("validation", "low", ["validation", "invalid", "format", "schema"]),
    ("user_input", "low", ["user", "input", "parameter", "argument"]),
]
PROCESSING_CONTEXTS = ["chunking", "enhancement", "analysis", "processing"]
NEVER_RETRY_TYPES = ["SystemExit", "KeyboardInterrupt", "ImportError", "SyntaxError"]

# --- fixed values: quality alerts ---------------------------------------------
ALERTS = {  # type: (threshold, window, severity)
    "quality_drop": (0.2, 10, "high"),
    "consistency_issue": (0.25, 15, "medium"),
    "low_batch_quality": (0.5, 5, "high"),
    "processing_slowdown": (2.0, 5, "medium"),
}
KEEP_SAMPLES = 100

# --- fixed values: record schema ----------------------------------------------
CONTENT_TYPES = ["qa", "dialogue", "monologue", "mixed", "unknown"]
TONES = list(TONE_KEYWORDS) + ["custom"]
