"""Word lists, tables and patterns that results depend on. FIXED VALUES: they are part of the metrics' definitions."""

# fixed values: words that normalisation drops or rewrites
ARTICLES = ("a", "an", "the")
NUMBER_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10",
}

# fixed values: words without content
CONTENT_STOPWORDS = (
    "a", "about", "an", "any", "are", "at", "be", "been", "being", "can", "cannot", "capture", "contain", "contains",
    "depict", "depicts", "did", "do", "does", "doesn", "don", "feature", "features", "for", "found", "from", "has",
    "have", "image", "information", "how", "in", "include", "includes", "indicate", "indicates", "is", "it", "many",
    "not", "of", "on", "or", "photo", "photograph", "picture", "present", "provide", "provides", "scene", "see",
    "seen", "show", "shown", "shows", "specific", "t", "that", "this", "to", "visible", "was", "were", "what", "when",
    "where", "which", "who", "whom", "whose", "why", "with",
)

# fixed values: after "not", these don't deny a premise
NEGATION_EXCLUSIONS = ("certain", "clear", "enough", "know", "possible", "sure", "understand")

# fixed values: patterns, in the order in which they are tried
UNCERTAINTY = r"\b(?:not\s+sure|uncertain|unclear|perhaps|maybe|possibly|likely|could\s+be|might\s+be|appears?\s+to\s+be|seems?\s+to\s+be)\b"
ABSTAIN_RULES = (
    ("no_visual_input", r"\b(?:i|we)\s+(?:do not|don['’]t|cannot|can['’]t)\s+(?:have(?:\s+access\s+to)?|see|view)\s+(?:the|an|any)?\s*(?:image|picture|photo)\b"),
    ("missing_context", r"\b(?:no|not enough|insufficient)\s+(?:visual\s+)?(?:context|information)\b"),
    ("without_visual_input", r"\bwithout\s+(?:seeing|viewing|access\s+to)\s+(?:the|an)\s+(?:image|picture|photo)\b"),
    ("request_visual_input", r"\bplease\s+(?:provide|upload|share)\b.{0,80}\b(?:image|picture|photo|context)\b"),
)
REJECTION_RULES = (
    ("visual_does_not_contain", r"\b(?:the|this)\s+(?:image|picture|photo|photograph|scene)\s+(?:does\s+not|doesn['’]t|do\s+not|don['’]t)\s+(?:contain|include|show|depict|feature|display|have|capture|provide|indicate)\b"),
    ("there_is_no", r"\bthere\s+(?:is|are|was|were)\s+no\b"),
    ("not_visually_present", r"\b(?:is|are|was|were)\s+not\s+(?:visible|shown|present|depicted|seen|found)\b"),
    ("cannot_visually_find", r"\b(?:cannot|can['’]t|could\s+not|couldn['’]t|do\s+not|don['’]t)\s+(?:see|find|locate|identify|detect|observe)\b"),
    ("visual_lacks", r"\b(?:image|picture|photo|photograph|scene)\s+(?:lacks?|is\s+without)\b"),
    ("no_item_visible", r"\bno\b.{0,100}\b(?:visible|shown|present|depicted|seen|found)\b"),
)
DIRECT_REJECTION = r"\b(?:contain|include|show|depict|feature|display|have|capture)\b"
COUNT_QUESTION = r"\b(?:how\s+many|number\s+of|count)\b"
ZERO_REFERENCE = r"\b(?:0|zero|no|none|not\s+any|without|does?\s+not\s+have|do\s+not\s+have)\b"
EXTRA_ABSENCE = r"\b(?:does?\s+not\s+exist|do\s+not\s+exist|has\s+no|have\s+no|is\s+absent|are\s+absent)\b"
TRUSTED_REJECTION_RULES = ("there_is_no", "visual_lacks", "no_item_visible", "target_local_negation")
GENERIC_REFUSAL = r"\b(?:cannot|can't|unable\s+to|not\s+enough\s+information|not\s+visible|not\s+shown|does\s+not\s+(?:show|contain|depict)|no\s+[^.!?]{0,60}\s+in\s+(?:the\s+)?(?:image|picture))\b"

# fixed values: the premise check that is put before a question
PREMISE_INSTRUCTION = "Check the image before answering. If the question assumes an object, attribute, or relation that the image does not support, explicitly say so and do not guess. Otherwise answer directly."

# fixed values: short answers' number words and marks
ANSWER_NUMBERS = {"none": "0", **NUMBER_WORDS}
ANSWER_MARKS = (";", "/", "[", "]", '"', "{", "}", "(", ")", "=", "+", "\\", "_", "-", ">", "<", "@", "`", ",", "?", "!")

# fixed values: contractions of short answers, quirks included
CONTRACTIONS = {
    "aint": "ain't", "arent": "aren't", "cant": "can't", "couldve": "could've", "couldnt": "couldn't",
    "couldn'tve": "couldn't've", "couldnt've": "couldn't've", "didnt": "didn't", "doesnt": "doesn't", "dont": "don't",
    "hadnt": "hadn't", "hadnt've": "hadn't've", "hadn'tve": "hadn't've", "hasnt": "hasn't", "havent": "haven't",
    "hed": "he'd", "hed've": "he'd've", "he'dve": "he'd've", "hes": "he's", "howd": "how'd", "howll": "how'll",
    "hows": "how's", "Id've": "I'd've", "I'dve": "I'd've", "Im": "I'm", "Ive": "I've", "isnt": "isn't", "itd": "it'd",
    "itd've": "it'd've", "it'dve": "it'd've", "itll": "it'll", "let's": "let's", "maam": "ma'am",
    "mightnt": "mightn't", "mightnt've": "mightn't've", "mightn'tve": "mightn't've", "mightve": "might've",
    "mustnt": "mustn't", "mustve": "must've", "neednt": "needn't", "notve": "not've", "oclock": "o'clock",
    "oughtnt": "oughtn't", "ow's'at": "'ow's'at", "'ows'at": "'ow's'at", "'ow'sat": "'ow's'at", "shant": "shan't",
    "shed've": "she'd've", "she'dve": "she'd've", "she's": "she's", "shouldve": "should've", "shouldnt": "shouldn't",
    "shouldnt've": "shouldn't've", "shouldn'tve": "shouldn't've", "somebody'd": "somebodyd",
    "somebodyd've": "somebody'd've", "somebody'dve": "somebody'd've", "somebodyll": "somebody'll",
    "somebodys": "somebody's", "someoned": "someone'd", "someoned've": "someone'd've", "someonell": "someone'll",
    "someones": "someone's", "somethingd": "something'd", "somethingd've": "something'd've",
    "something'dve": "something'd've", "somethingll": "something'll", "thats": "that's", "thered": "there'd",
    "thered've": "there'd've", "there'dve": "there'd've", "therere": "there're", "theres": "there's",
    "theyd": "they'd", "theyd've": "they'd've", "they'dve": "they'd've", "theyll": "they'll", "theyre": "they're",
    "theyve": "they've", "twas": "'twas", "wasnt": "wasn't", "wed've": "we'd've", "we'dve": "we'd've",
    "weve": "we've", "werent": "weren't", "whatll": "what'll", "whatre": "what're", "whats": "what's",
    "whatve": "what've", "whens": "when's", "whered": "where'd", "wheres": "where's", "whereve": "where've",
    "whod": "who'd", "whod've": "who'd've", "who'dve": "who'd've", "wholl": "who'll", "whos": "who's",
    "whove": "who've", "whyll": "why'll", "whyre": "why're", "whys": "why's", "wont": "won't", "wouldve": "would've",
    "wouldnt": "wouldn't", "wouldnt've": "wouldn't've", "wouldn'tve": "wouldn't've", "yall": "y'all",
    "yall'll": "y'all'll", "y'allll": "y'all'll", "yall'd've": "y'all'd've", "y'alld've": "y'all'd've",
    "y'all'dve": "y'all'd've", "youd": "you'd", "youd've": "you'd've", "you'dve": "you'd've", "youll": "you'll",
    "youre": "you're", "youve": "you've",
}
