"""Word lists and tag groups of the style measures."""

from __future__ import annotations

# Results depend on these lists word for word.
SUBORDINATORS = "because although though while since unless if when whereas until after before that which who whom whose".split()
COORDINATORS = "and but or so yet nor".split()
FUNCTION_WORDS = (
    "the of and a to in is you that it he was for on are as with his they i at be this have from or one had by but not what all were "
    "we when your can there use an each which she do how their if will up other about out many then them these so some her would "
    "make like him into time has more go see no way could people my than been who now find long day get come may just really "
    "actually still even much very too also always never think know need want thing things im dont thats ive isnt cant youre theyre"
).split()
STOPWORDS = (
    "the a an and or but if then of to in on at for with as is are was were be been am it its this that these those i you he she "
    "they we them his her their my your our me him us do does did have has had not no so just very too also there here what which "
    "who when where why how all any both each few more most other some such only own same than s t d ll m re ve don didn doesn isn "
    "aren wasn weren won can will would could should about from by out up down into over under again once"
).split()
#: Groups of Penn Treebank tags, in the order in which they are reported.
POS_GROUPS = {
    "nouns": ("NN", "NNS", "NNP", "NNPS"),
    "verbs": ("VB", "VBD", "VBG", "VBN", "VBP", "VBZ"),
    "adjectives": ("JJ", "JJR", "JJS"),
    "adverbs": ("RB", "RBR", "RBS"),
    "pronouns": ("PRP", "PRP$"),
    "determiners": ("DT",),
    "prepositions": ("IN",),
    "modals": ("MD",),
    "conjunctions": ("CC",),
}
#: Openers that make a post lean on another one; those with a space must be followed by a word.
DEPENDENT_OPENERS = (
    "yes", "no", "yeah", "nah", "yep", "nope", "agreed", "exactly", "same", "true", "false", "this", "lol", "lmao", "correct", "right", "wrong", "thanks", "thank you", "congrats", "nice",
    "cool", "sure", "ok", "okay", "i agree", "i disagree", "me too", "and ", "but ", "or ", "so ", "because ", "which ", "who ", "that's it",
)

# Our own tagger's closed classes and endings; the tags are those of the Penn Treebank.
TAG_WORDS = {
    "DT": "the a an this that these those each every some any no all both either neither another".split(),
    "MD": "can could may might must shall should will would ca wo cannot".split(),
    "CC": "and but or nor yet so plus".split(),
    "PRP": "i you he she it we they me him her us them myself yourself himself herself itself ourselves themselves".split(),
    "PRP$": "my your his its our their mine yours hers ours theirs".split(),
    "IN": "of in on at for with by from into over under about after before between through during without within against among along across behind beyond near since until upon toward towards "
    "if because although though while unless whereas whether than as like per via".split(),
    "TO": ["to"],
    "RB": "not n't very too also just never always often still even already soon now then here there again once ever almost quite rather really actually maybe perhaps only please away back together later sometimes usually especially however instead yet well far".split(),
    "NN": "morning evening thing nothing something anything everything meeting building spring string king ring wedding ceiling music nobody somebody everybody everyone someone anyone logic public traffic metal animal journal hospital red gas bus".split(),
    "JJ": (
        "good new old great big small large long little high low young early late important bad able best better real sure free full clear easy hard strong whole other same different next last first own fresh heavy light dark quiet loud quick slow warm cold hot cool dry wet rich poor "
        "happy sad nice strange simple rare common main major final latest recent modern ancient honest clever wide narrow deep flat soft rough sharp thin thick weak brave calm kind fair true false wrong right ready busy empty close open clean dirty safe tired awake alone worth more most "
        "less black white blue green yellow brown red gray familiar similar popular broken boring"
    ).split(),
    "VB": (
        "be do have go get make see know think want need take come give find tell ask use try keep let say seem feel leave call show hear play run move live believe hold bring happen write provide sit stand lose pay meet include continue set learn change lead understand watch follow "
        "stop create speak read allow add spend grow walk win offer remember love consider appear buy wait serve die send expect build stay fall cut reach kill remain suggest raise pass sell require report decide pull forget trust visit eat drink sleep drive open close begin start "
        "choose break carry draw fight fly hang hide hit throw wear teach sing swim bake taste sound look help check agree like enjoy"
    ).split(),
    "VBD": (
        "was were did had went got made saw knew thought took came gave found told said kept left felt became began brought bought built caught chose drove drank ate fell flew forgot grew held heard hid led lost met paid ran sat sold sent sang slept spoke spent stood swam taught threw "
        "understood wore won wrote drew broke rose shook stuck struck"
    ).split(),
    "VBZ": "is are am 's 're 'm has does goes gets makes says needs wants".split(),
    "VBN": "been done gone seen known taken given".split(),
    "WP": "who whom whose what which when where why how".split(),
}
TAG_ENDINGS = [("VBG", "ing"), ("VBD", "ed"), ("RB", "ly"), ("JJ", "ous"), ("JJ", "ful"), ("JJ", "ive"), ("JJ", "able"), ("JJ", "ible"), ("JJ", "less"), ("JJ", "ish"), ("JJ", "ic"), ("JJ", "al"), ("NNS", "s")]
