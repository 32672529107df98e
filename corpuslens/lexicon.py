"""Word lists, letter classes and thresholds that the results depend on."""

DIACRITICS = "[ؐ-ًؚ-ٰٟۖ-ۭ]"
TATWEEL = "ـ"
LETTERS_FROM, LETTERS_TO = "أإآٱىئؤة", "ااااييوه"
NOT_ARABIC = "[^ء-ي0-9]+"
HONORIFICS = (
    "صلى الله عليه وسلم", "صلي الله عليه وسلم", "رضى الله عنهما", "رضي الله عنهما", "رضى الله عنها", "رضي الله عنها",
    "رضى الله عنه", "رضي الله عنه", "رضى الله عنهم", "رضي الله عنهم", "عليه السلام", "عليه الصلاه والسلام",
)
STOPWORDS = """
في من على عن الى إلى ان أن إن ما لا لم لن قد ثم او أو و ف ب ل هو هي هم هن انا أنا انت
نحن كان كانت يكون قال قالت فقال فقالت يقول تقول قالوا الله رسول النبي صلى عليه وسلم
هذا هذه ذلك تلك الذي التي الذين حتى اذا إذا كل بن ابن ابي أبي ابو أبو عنه عنها له لها
به بها منه منها فيه فيها يا اي أي مع بعد قبل عند
"""
REFERS_BACK = ("بمثله", "مثله", "بنحوه", "نحوه", "بمعناه", "بهذا الاسناد", "بهذا الحديث", "بمثل حديث", "نحو حديث", "مثل حديث")
REFERS_BACK_WORDS = 25
TOPIC_STARTS = ("حديث", "احاديث", "ابحث", "اريد", "ما هو", "ما هي")
TOPIC_LINKS = ("عن", "في", "حديث")
STEM_PREFIXES = ("وال", "فال", "بال", "كال", "لل", "ال", "و", "ف", "ب")
EMPTY_WORDS = ("nan", "none", "null")
CLEANED_FIELDS = ("isnad", "matn", "remark", "grade", "section_title", "chapter")

T_FOUND, T_NEAR, T_FAMILY, T_STORED = 0.85, 0.70, 0.45, 0.30
BM25_K1, BM25_B, BM25_CUT, ALIGNED, RESULTS = 1.4, 0.75, 150, 40, 10
MAX_QUERY_CHARS = 1500  # of a search box; stored cases are taken whole
MAX_ALIGN_WORDS, MAX_ANCHORS = None, None  # no limit: whole queries are aligned, beside every anchor
FUZZY_CUT, FUZZY_FLOOR, FUZZY_KEPT = 60, 0.4, 3
FAMILY_KEPT, LOOK_BACK, MAX_ROUTES = 40, 3, 24
T_SAME_TEXT, T_CANDIDATE, COMPARABLE, GRADES_KEPT, TEXT_CUT = 0.80, 0.60, 0.5, 12, 300
RECALL_AT = (1, 3, 5, 10)
SAMPLE_SEED, SAMPLE_PER_BOOK = "sample-v1", 3
CONFUSABLE = {"ذ": "ز", "ز": "ذ", "ض": "ظ", "ظ": "ض", "س": "ص", "ص": "س", "ت": "ط", "ط": "ت", "ح": "ه", "ث": "س"}
CATEGORIES = ("exact", "partial", "variation", "meaning", "conflict", "spelling", "not_in_six_books")
FLOORS = {
    "overall": {"recall_at_1": 0.908, "recall_at_3": 0.985, "recall_at_10": 0.985, "mrr": 0.944},
    "exact": {"recall_at_1": 1.0, "recall_at_10": 1.0, "mrr": 1.0},
    "partial": {"recall_at_1": 0.966, "recall_at_10": 0.966, "mrr": 0.966},
    "spelling": {"recall_at_1": 0.722, "recall_at_3": 1.0, "mrr": 0.852},
}

# Rewritings of a name's spelling: "father of" in any case (but for the name Ubayy), "son of" inside a name, and what is no part of its end.
CANONICAL = (
    (r"^(?:ابي|ابا) (?!(?:بن|ابن)(?: |$))", "ابو "),
    (r"(?<= )ابن(?= |$)", "بن"),
    (r"(?:(?:^| )(?:قال|قالت|يقول|انه|ان|في|من|و))+$", ""),
)
# Grades that are withheld from a record's card, by the words they hold.
WITHHELD = ("موضوع", "متواتر")
