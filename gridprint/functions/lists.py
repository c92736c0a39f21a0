"""Word lists and character tables that results depend on."""

#: English function words, those with a meaning of their own in technical text left out, and some more put in.
BASE_STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she she's her hers herself "
    "it it's its itself they them their theirs themselves what which who whom this that that'll these those am is are was were be been being have has "
    "had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after "
    "above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some "
    "such no nor not only own same so than too very s t can will just don don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn "
    "didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn "
    "wasn't weren weren't won won't wouldn wouldn't"
).split()
STOP_EXCEPTIONS = "need use used using without across between multiple single further new own same such most more less".split()
EXTRA_STOP_WORDS = "also however therefore thus et al eg ie etc would could may might one two three".split()
STOP_WORDS = sorted(set(BASE_STOP_WORDS) - set(STOP_EXCEPTIONS) | set(EXTRA_STOP_WORDS))

#: Characters that Arabic text is folded by: from, to; those without a counterpart are deleted.
ARABIC_FOLD_FROM = "أإآىةیکگۀٱئ" + "ًٌٍَُِّْٰ"
ARABIC_FOLD_TO = "اااي" + "هيككهاي"
ARABIC_LETTERS = "؀-ۿ"
PERSIAN_LETTERS = "پچژگ"
ARABIC_CLITICS = "و ف ب ل ك س بال فل ول فب".split()

#: A core of Arabic function words; callers may pass their own list.
ARABIC_PREPOSITIONS = "من في الي علي عن مع حتي منذ دون بين فوق تحت خلف وراء قدام امام عند لدي حيال".split()
ARABIC_PARTICLES = "ثم او ام بل لكن لعل كي لا لم لن لما ليس غير الا سوي قد هل سوف ان كان لقد انما اذا لو لولا اذ حيث هو هي هم ما الذي التي الذين هذا هذه ذلك تلك".split()
ARABIC_PRONOUN_ENDINGS = "ه ها هم كم ك نا ي".split()
#: Rule: particles and prepositions, alone or after a conjunction, and short prepositions with a pronoun.
ARABIC_FUNCTION_WORDS = sorted({c + w for c in ("", "و", "ف") for w in ARABIC_PREPOSITIONS + ARABIC_PARTICLES} | {p + e for p in ("ب", "ل", "في", "من", "عن", "علي", "الي", "عند", "مع") for e in ARABIC_PRONOUN_ENDINGS})

#: Treebank tag prefix to part of speech; participles count as adjectives.
POS_TAGS = {"JJ": "a", "VBN": "a", "VBG": "a", "VB": "v", "NN": "n", "RB": "r"}

#: Suffix rules of the built-in lemmatiser: the first that fits and leaves three letters applies.
NOUN_SUFFIXES = [("sses", "ss"), ("ies", "y"), ("ches", "ch"), ("shes", "sh"), ("xes", "x"), ("zes", "z"), ("ss", "ss"), ("us", "us"), ("is", "is"), ("s", "")]
VERB_SUFFIXES = [("ies", "y"), ("ing", ""), ("ied", "y"), ("ed", ""), ("s", "")]
IRREGULAR = {"men": "man", "women": "woman", "children": "child", "people": "person", "feet": "foot", "teeth": "tooth", "mice": "mouse", "data": "datum", "better": "good", "best": "good", "worse": "bad", "worst": "bad", "was": "be", "were": "be", "is": "be", "are": "be", "been": "be", "has": "have", "had": "have", "went": "go", "gone": "go"}

#: Words that tell a credit problem of a language-model service from other failures.
CREDIT_WORDS = ["credit", "quota", "insufficient", "payment", "billing"]
