"""Word lists, lookup tables, patterns and constants.

Every value here is fixed by the behaviour this library reproduces and is kept
as plain data in its natural order.  Nothing in this module computes anything;
``operators.lexicon`` turns the lists into DataFrames.
"""

# --- Fixed values: characters that count as white space in timed text -------
_SPACE_RANGES = ((0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F),
                 (0x205F, 0x205F), (0x3000, 0x3000), (0xFEFF, 0xFEFF))
# written as the inside of a character class
WHITESPACE = "\t\n\x0b\x0c\r " + "".join(f"{chr(a)}-{chr(b)}" if a < b else chr(a) for a, b in _SPACE_RANGES)

# --- Fixed values: default lexicon (words and phrases) ----------------------
DEFAULT_TERMS = """
anal, analsex, anus, arse, arsehole, ass, asshole, assholes, asswipe, asswipes,
badass, badasses, ballsack, bastard, bastards, bitch, bitchass, bitched,
bitches, bitchin, bitching, blowjob, blowjobs, bollocks, boner, bullshit, clit,
clitoris, cock, cockhead, cock sucker, cocks, cocksucker, cocksucking, crap,
crappy, christ, christ killer, christ killers, cum, cumshot, cumslut, cunt,
cuntface, cuntfuck, cunts, damn, damnable, damned, dammit, damnit, dick,
dickhead, dicks, dickwad, dickweed, dildo, dildos, douche, douchebag, fag,
faggot, faggs, fags, fuck, fucked, fucker, fuckers, fuckface, fuckhead,
fucking, fucknut, fucks, fucktard, fuckup, fuckwad, fuckwit, fuckyou, god,
god damn, god damnit, god dammit, god-damn, god-damned, goddamn, goddamnit,
gods, hell, hoe, hoes, jackass, jerkoff, jesus, kunt, lord, masterbate,
masterbating, masturbate, masturbating, motherfucker, motherfucking, nigga,
nigger, niggers, nipple, nipples, nude, orgasm, penis, piss, pissed, pissing,
porn, porno, pornography, pussy, pussys, retard, retarded, rimjob, scrotum,
sex, sexy, shag, shagged, shagging, shit, shits, shitted, shitting, shitty,
shut up, skank, slut, sluts, slutty, son of a bitch, spic, spunk,
swear to god, suck, sucked, sucker, sucks, sucking, tit, tits, titties, titty,
twat, vagina, wank, wanker, wanking, whore, whores, whoring, wtf, xxx
"""

# --- Fixed values: terms let through at low sensitivity ---------------------
EXEMPT_TERMS = """
god, gods, hell, jesus, christ, christian, christianity, damn, damnable,
damned, damnation, lord, bless, blessed, blessing, bible, prayer, prayers,
pray, praying, heaven, heavens, holy, saint, saints, angel, angels, devil,
satan
"""

# --- Fixed values: look-alike characters and the letters they stand for -----
LOOKALIKE_FROM = "@431!05$7+"
LOOKALIKE_TO = "aaeiiosstt"

# --- Fixed values: obfuscated words -----------------------------------------
# (word reported to the rules, letters, optional ending as a regular expression)
SPACER = r"[_\-.*@#$&%!?]*"
OBFUSCATED_WORDS = [
    ("fuck", "fuck", SPACER + "s?"),
    ("shit", "shit", SPACER + "s?"),
    ("bitch", "bitch", "(?:es)?"),
    ("cunt", "cunt", SPACER + "s?"),
    ("dick", "dick", SPACER + "s?"),
    ("ass", "ass", "(?:holes?|wipes?|es)?"),
    ("pussy", "pussy", ""),
    ("bastard", "bastard", SPACER + "s?"),
    ("damn", "damn", ""),
    ("hell", "hell", ""),
]

# --- Fixed values: context rules (term, kind, pattern, case sensitive) ------
CONTEXT_RULES = [
    ("cock", "allowed", r"\b(guns?\s+cock|cock(ed)?\s+(the\s+)?gun|hammer\s+cock|cock\s+hammer)\b", False),
    ("cock", "allowed", r"\b(rooster|cock\s+of\s+the|cockeyed|cocktail|cockpit|weathercock)\b", False),
    ("cock", "allowed", r"\b\[\w*\]\s*[\[\(]?.*cock", False),
    ("cock", "profane", r"\b(suck\s+cock|cock\s+suck|big\s+cock|hard\s+cock|cock\s+in|cock\s+out)\b", False),
    ("cock", "profane", r"\b(lick\s+cock|cock\s+head|cock\s+face)\b", False),
    ("suck", "allowed", r"\b(suck\s+up|sucking\s+up|sucks?\s+to\s+be)\b", False),
    ("suck", "allowed", r"\b(suck\s+it\s+up|suck\s+it\s+in)\b", False),
    ("suck", "allowed", r"\b(suck(er)?s?\s+(on|at|in)\s+(teeth|breath|air))\b", False),
    ("suck", "profane", r"\b(suck\s+(my|his|her|a|the)\s+(cock|dick|balls?))\b", False),
    ("suck", "profane", r"\b(cock\s+suck|dick\s+suck)\b", False),
    ("sucking", "allowed", r"\b(sucking\s+up)\b", False),
    ("sucking", "allowed", r"\b(sucks?\s+to\s+be)\b", False),
    ("sucking", "profane", r"\b(sucking\s+(cock|dick|balls?))\b", False),
    ("ass", "allowed", r"\bA\.?S\.?S\.?\b", True),
    ("ass", "allowed", r"\bASS\b(?!hole|wipe|hat)", True),
    ("balls", "allowed", r"\b(balls?\s+(game|field|court|park|room))\b", False),
    ("balls", "allowed", r"\b(have\s+a\s+ball|having\s+a\s+ball)\b", False),
    ("balls", "allowed", r"\b(ball\s+room|ball\s+park|ball\s+point)\b", False),
    ("balls", "profane", r"\b(suck\s+balls?|lick\s+balls?|my\s+balls?)\b", False),
    ("hell", "allowed", r"\bshell\b", False),
    ("hell", "allowed", r"\b(hells?\s+(kitchen|angels?|bells?))\b", False),
    ("damn", "allowed", r"\bbeaver\s+dam\b", False),
    ("damn", "allowed", r"\bdam\b(?!\n)", False),
    ("damn", "profane", r"\bgoddamn?\b", False),
    ("damn", "profane", r"\bdamn\s+(it|you|him|her|them)\b", False),
    ("crap", "none", "", False),
    ("pussy", "allowed", r"\b(pussy\s+(cat|willow|cats?))\b", False),
    ("hoe", "allowed", r"\b(garden\s+)?hoe(s)?\b(?!s\b)", False),
    ("hoe", "allowed", r"\buse\s+(a\s+)?hoe\b", False),
    ("hoe", "allowed", r"\bhoe\s+(the\s+)?(garden|field|soil)\b", False),
]
CONTEXT_CHARS = 50

# --- Fixed values: confidences and thresholds --------------------------------
EXACT_CONFIDENCE = 100.0
PATTERN_CONFIDENCE = 95.0
UNSURE_CONFIDENCE = 75.0
FLAG_AT = {"low": 80.0, "medium": 50.0, "high": 20.0}
CENSOR_MARK = "[CENSORED]"

# --- Fixed values: mute windows ----------------------------------------------
PADS = {"low": (200, 150), "medium": (500, 300)}
MUTE_EARLY_MS = 500
MUTE_LATE_MS = 25
FALLBACK_RATE = {"wpm": 170.0, "ms_per_syllable": 175.0, "syllables_per_word": 1.5}

# --- Fixed values: replacement words, one list a category ---------------------
ROOT_SUBSTITUTIONS = [  # term, silly, polite, random
    ("fuck", ["fudge", "frick", "freak", "fiddlesticks", "firetruck", "fluffernutter", "frock"], ["darn", "bother", "drat"], ["bananas", "noodles", "shenanigans"]),
    ("fucking", ["fudging", "fricking", "freaking", "fiddlesticks-ing", "flabbergasted"], ["darned", "blasted", "confounded"], ["noodly", "bananarama"]),
    ("fucker", ["fudger", "frick-fracker", "fire-trucker", "fellow"], ["jerk", "meanie", "rascal"], ["noodle", "potato"]),
    ("shit", ["shoot", "shiz", "shenanigans", "sugar", "shucks", "spaghetti", "poopypants"], ["crap", "poop", "dung"], ["bananas", "noodles", "wibbly-wobbly"]),
    ("shithead", ["shoothead", "sillyhead", "poopyhead", "noodlehead", "spaghetti-head"], ["dummy", "fool", "nitwit"], ["banana-brain", "potato-head"]),
    ("bullshit", ["bullshoot", "bullroar", "malarkey", "flapdoodle", "poppycock", "codswallop"], ["nonsense", "rubbish", "hogwash"], ["banana-oil", "fairy-tales"]),
    ("shut up", ["hush up", "hush", "hush your mouth", "quiet", "quiet please"], ["please be quiet", "hush", "quiet down"], ["zip it", "shush", "muffle"]),
    ("bitch", ["beach", "birch", "bench", "britch", "biscuit", "butterscotch"], ["meanie", "jerk", "rude person"], ["banana", "noodle", "pickle"]),
    ("bitchy", ["beachy", "britchy", "grumpy-pants", "crab-apple"], ["grouchy", "irritable", "cranky"], ["noodly", "bananical"]),
    ("cunt", ["cant", "coot", "clown", "coconut", "cucumber", "cabbage"], ["jerk", "meanie", "unpleasant person"], ["banana", "potato", "noodle"]),
    ("dick", ["dickens", "dingle", "dork", "ding-dong", "donut", "duck"], ["jerk", "meanie", "rascal"], ["noodle", "banana", "potato"]),
    ("dickhead", ["dinglehead", "ding-dong-head", "dorkasaurus", "doofus-head"], ["jerk", "dummy", "fool"], ["banana-brain", "potato-head", "noodle-noggin"]),
    ("ass", ["asterisk", "applesauce", "avocado", "anteater", "ankle"], ["butt", "bottom", "rear"], ["banana", "noodle", "potato"]),
    ("asshole", ["asterisk-hole", "applesauce", "avocado", "ankle", "airhead"], ["jerk", "meanie", "rude person"], ["banana-peel", "noodle-nose", "potato-face"]),
    ("asshat", ["asterisk-hat", "applesauce-hat", "avocado-hat", "ankle-hat"], ["jerk", "fool", "nitwit"], ["banana-cap", "noodle-hat"]),
    ("pussy", ["pushy", "pussycat", "pistol", "pumpkin", "pancake", "pastry"], ["wimp", "coward", "scaredy-cat"], ["banana", "noodle", "potato"]),
    ("bastard", ["bass-tard", "barnacle", "buttercup", "biscuit-eater", "buffoon"], ["jerk", "meanie", "rascal", "scoundrel"], ["banana-muffin", "potato-cake", "noodle-brain"]),
    ("damn", ["darn", "dang", "doggone", "dangit", "drat", "dagnabbit"], ["bother", "drat"], ["bananas", "fiddlesticks"]),
    ("damnable", ["darnable", "blasted", "confounded"], ["terrible", "awful"], ["banana-ish", "noodly"]),
    ("damned", ["darned", "danged", "dratted"], ["cursed", "blighted"], ["bananad", "noodled"]),
    ("god", ["gosh", "golly", "goodness", "gadzooks", "gee"], ["goodness", "gracious"], ["banana", "noodle"]),
    ("lord", ["gosh", "golly", "goodness", "gracious me"], ["goodness", "gracious"], ["banana", "noodle"]),
    ("badass", ["coolcat", "toughguy", "braveheart", "superkid"], ["tough one", "brave one"], ["banana", "noodle", "wombat"]),
    ("gods", ["goshes", "gollies", "deities", "divinities"], ["heavens", "goodness"], ["bananas", "noodles"]),
    ("goddamn", ["goddarn", "goddang", "goldarn", "gol-durn"], ["confounded", "blasted"], ["banana-banana", "noodly-goodness"]),
    ("hell", ["heck", "h-e-double-hockey-sticks", "hades", "hullabaloo"], ["heck", "darn"], ["bananas", "noodles"]),
    ("jesus", ["jeez", "jeepers", "jiminy", "jumping-jehoshaphat", "jiminy-cricket"], ["goodness", "gracious", "heavens"], ["banana", "noodle"]),
    ("christ", ["crikey", "crumbs", "crickey", "criminy", "caramba"], ["goodness", "heavens"], ["banana", "noodle"]),
    ("crap", ["cwap", "cranberries", "crackers", "crayons", "crumb-cake"], ["poop", "darn", "shoot"], ["bananas", "noodles", "spaghetti"]),
    ("whore", ["warlord", "warthog", "wombat", "walrus", "waffle"], ["jerk", "meanie", "rascal"], ["banana", "noodle", "potato"]),
    ("slut", ["sloth", "sloth-face", "slug", "slippers", "slushie"], ["jerk", "meanie", "rascal"], ["banana", "noodle", "potato"]),
    ("twat", ["twit", "twonk", "twinkie", "tweedy", "twerp"], ["jerk", "fool", "nitwit"], ["banana", "noodle", "wombat"]),
    ("wanker", ["waffle", "wonka", "weasel", "wombat", "waffle-iron"], ["jerk", "fool", "idiot"], ["banana", "noodle", "potato"]),
    ("bollocks", ["bailiffs", "bangers", "biscuits", "balloons", "bananas"], ["nonsense", "rubbish", "poppycock"], ["noodly-nonsense", "spaghetti-speak"]),
    ("piss", ["fizz", "fuzzy", "prune", "peach", "pixel", "pickle"], ["pee", "tinkle"], ["banana", "noodle"]),
    ("pissed", ["ticked", "miffed", "fizzed", "frazzled", "flustered"], ["angry", "upset", "annoyed"], ["bananas", "noodly"]),
    ("cock", ["cork", "chalk", "clock", "cabbage", "coconut", "cat"], ["jerk", "meanie"], ["banana", "noodle", "potato"]),
    ("tits", ["tips", "toots", "treats", "twinkies", "tater-tots"], ["jerk", "meanie", "dummy"], ["bananas", "noodles"]),
    ("nigga", ["neighbor", "ninja", "noodle", "novice", "newbie"], ["friend", "brother", "person"], ["banana", "potato"]),
    ("nigger", ["neighbor", "ninja", "noodle", "novice", "newbie"], ["friend", "brother", "person"], ["banana", "potato"]),
    ("son of a bitch", ["son of a biscuit", "son of a gun", "son of a sea biscuit", "son of a sandwich"], ["rascal", "scoundrel", "jerk"], ["child of a banana", "offspring of spaghetti", "heir of sunshine"]),
    ("swear to god", ["promise on my popcorn", "cross my heart", "hope to sprout", "swear on my sandwich", "pinky swear"], ["I promise", "I assure you", "honestly", "truly"], ["I vow on a potato", "may my noodles turn cold", "by the power of pizza"]),
    ("arse", ["asterisk", "avocado", "ankle", "applesauce", "anteater"], ["butt", "bottom", "rear"], ["banana", "noodle", "potato"]),
    ("arsehole", ["asterisk-hole", "avocado", "ankle", "airhead", "applesauce"], ["jerk", "meanie", "rude person"], ["banana-peel", "noodle-nose", "potato-face"]),
    ("bitchass", ["beach-buns", "birch-bottom", "biscuit-booty", "bench-bottom"], ["total jerk", "complete meanie"], ["banana-noodle", "potato-cake"]),
    ("douche", ["dandelion", "dodo", "dipstick", "dirt-bike", "doughnut"], ["jerk", "meanie", "fool"], ["banana", "potato", "noodle"]),
    ("douchebag", ["dandelion-bag", "dodo-bag", "dipstick", "doughnut-bag"], ["jerk", "meanie", "rascal"], ["banana-bag", "potato-sack"]),
    ("dumbass", ["silly-goose", "numbskull", "goofball", "blockhead", "dingbat"], ["fool", "silly person", "unwise person"], ["noodle-head", "potato-brain"]),
    ("fag", ["fog", "fig", "fudge", "flag", "fizz"], ["jerk", "bully", "meanie"], ["banana", "noodle", "waffle"]),
    ("hells", ["hecks", "h-e-double-hockey-sticks-es", "hadeses", "hullaballoos"], ["hecks", "darns"], ["bananas", "noodles"]),
    ("jackass", ["jack-rabbit", "jackfruit", "jack-in-the-box", "jelly-bean"], ["fool", "nitwit", "rascal"], ["banana-split", "potato-head"]),
    ("motherfucker", ["mother-trucker", "muffin-trucker", "moose-tracker", "maple-tracker"], ["jerk", "terrible person", "villain"], ["banana-truck", "noodle-wagon", "potato-cart"]),
    ("motherfucking", ["mother-trucking", "muffin-trucking", "moose-tracking"], ["terribly", "awfully", "darned"], ["banana-trucking", "noodle-riding"]),
    ("niglet", ["nugget", "noodle", "nubbin", "newbie"], ["child", "youngster", "little one"], ["banana", "potato"]),
    ("pissed off", ["ticked off", "steamed up", "frazzled", "flummoxed", "discombobulated"], ["angry", "upset", "annoyed"], ["bananad", "noodled"]),
    ("retard", ["noodlebrain", "scatterbrain", "dingbat", "goofball"], ["unwise person", "someone who made a mistake"], ["banana-brain", "potato-head"]),
    ("skank", ["skunk", "skillet", "skate", "skipper"], ["jerk", "meanie", "rascal"], ["banana", "noodle", "potato"]),
    ("white trash", ["wild raccoon", "wobbly washing machine", "waffle crumbs"], ["rude person", "inconsiderate person"], ["banana-peel", "noodle-strings"]),
    ("wanking", ["waffling", "waltzing", "wandering", "wobbling"], ["fooling around", "dawdling"], ["banana-dancing", "noodle-flailing"]),
    ("beaner", ["beanbag", "bean-counter", "bean-sprout"], ["jerk", "bully", "meanie"], ["banana", "noodle", "waffle"]),
    ("chink", ["chime", "chinchilla", "chipmunk", "cherry"], ["jerk", "bully", "meanie"], ["banana", "noodle", "waffle"]),
    ("gook", ["goose", "gopher", "gummy-bear", "gobstopper"], ["jerk", "bully", "meanie"], ["banana", "noodle", "waffle"]),
    ("kike", ["kite", "kiwi", "kitten", "kale"], ["jerk", "bully", "meanie"], ["banana", "noodle", "waffle"]),
    ("spic", ["spice", "sparkle", "spinach", "sprinkle"], ["jerk", "bully", "meanie"], ["banana", "noodle", "waffle"]),
    ("wetback", ["watermelon-back", "waffle-back", "water-slide"], ["jerk", "bully", "meanie"], ["banana", "noodle", "waffle"]),
    ("honky", ["honk-honk", "hamster", "honeycomb"], ["jerk", "bully", "meanie"], ["banana", "noodle", "waffle"]),
    ("wop", ["waffle", "walrus", "wombat", "windmill"], ["jerk", "bully", "meanie"], ["banana", "noodle", "pretzel"]),
    ("dago", ["daisy", "daffodil", "dandelion"], ["jerk", "bully", "meanie"], ["banana", "noodle", "waffle"]),
    ("dego", ["daisy", "daffodil", "dandelion"], ["jerk", "bully", "meanie"], ["banana", "noodle", "waffle"]),
    ("jap", ["jigsaw", "jellybean", "jamboree", "jalapeno"], ["jerk", "bully", "meanie"], ["banana", "noodle", "waffle"]),
    ("kraut", ["crouton", "croissant", "cucumber"], ["jerk", "bully", "meanie"], ["banana", "noodle", "waffle"]),
    ("polack", ["polka-dot", "pond-skater", "popsicle"], ["jerk", "bully", "meanie"], ["banana", "noodle", "waffle"]),
    ("mick", ["microwave", "mittens", "muffin", "marshmallow"], ["jerk", "bully", "meanie"], ["banana", "noodle", "waffle"]),
    ("paki", ["panda", "pumpkin", "pineapple", "pogo-stick"], ["jerk", "bully", "meanie"], ["banana", "noodle", "waffle"]),
    ("coon", ["coon-hound", "cucumber", "cupcake", "coconut"], ["jerk", "bully", "meanie"], ["banana", "noodle", "waffle"]),
    ("hebe", ["honeybee", "himalayan", "huckleberry"], ["jerk", "bully", "meanie"], ["banana", "noodle", "waffle"]),
    ("shylock", ["shamrock", "shelter", "sherbet", "shovel"], ["jerk", "bully", "meanie"], ["banana", "noodle", "waffle"]),
    ("yid", ["yodel", "yo-yo", "yogurt", "yam"], ["jerk", "bully", "meanie"], ["banana", "noodle", "waffle"]),
    ("abbo", ["abacus", "accordion", "avocado"], ["jerk", "bully", "meanie"], ["banana", "noodle", "waffle"]),
    ("macaca", ["macaroni", "maraca", "mango", "magpie"], ["jerk", "bully", "meanie"], ["banana", "noodle", "waffle"]),
    ("sambo", ["samba", "sunflower", "sandcastle"], ["jerk", "bully", "meanie"], ["banana", "noodle", "waffle"]),
    ("nazi", ["nacho", "noodle-soup", "nugget-bucket"], ["villain", "bully", "terrible person"], ["banana", "potato", "waffle"]),
    ("swastika", ["spiral", "starburst", "swirl", "suncatcher"], ["bad symbol", "hate symbol"], ["banana", "noodle", "pretzel"]),
    ("anal", ["annual", "antenna", "anchovy", "anvil"], ["rude", "inappropriate"], ["banana", "noodle", "waffle"]),
    ("anus", ["anchor", "ankle", "anvil", "avocado"], ["bottom", "rear"], ["banana", "noodle", "waffle"]),
    ("boner", ["bongo", "bonfire", "bologna", "bobsled"], ["mistake", "blunder", "error"], ["banana", "noodle", "pretzel"]),
    ("clit", ["clock", "clam", "cloudberry", "clover"], ["rude word", "inappropriate word"], ["banana", "noodle", "waffle"]),
    ("cum", ["cookie", "cupcake", "compass", "cucumber"], ["arrive", "finish", "reach"], ["banana", "noodle", "waffle"]),
    ("dildo", ["dinosaur", "dilapidated-duck", "dill-pickle", "diving-board"], ["rude object", "inappropriate item"], ["banana", "noodle", "waffle"]),
    ("hentai", ["henna", "helicopter", "hemisphere", "hemp"], ["inappropriate show", "rude cartoon"], ["banana", "noodle", "waffle"]),
    ("orgasm", ["orchestra", "organism", "orangutan", "ostrich"], ["happy moment", "thrill", "excitement"], ["banana", "noodle", "waffle"]),
    ("porn", ["popcorn", "porcupine", "porthole", "postcard"], ["inappropriate content", "rude content", "bad content"], ["banana", "noodle", "waffle"]),
    ("porno", ["popcorn", "porcupine", "porthole", "portobello"], ["inappropriate content", "rude content", "bad content"], ["banana", "noodle", "waffle"]),
    ("schlong", ["schedule", "schnauzer", "schooner", "skipper"], ["rude word", "inappropriate word"], ["banana", "noodle", "waffle"]),
    ("dong", ["dungeon", "dodo-bird", "dolphin", "doorbell"], ["rude word", "inappropriate word"], ["banana", "noodle", "waffle"]),
    ("pecker", ["peacock", "peanut", "pelican", "pendulum"], ["rude word", "inappropriate word"], ["banana", "noodle", "waffle"]),
    ("choad", ["toad", "choir", "chowder", "chimichanga"], ["rude word", "inappropriate word"], ["banana", "noodle", "waffle"]),
    ("chode", ["toad", "choir", "chowder", "chimichanga"], ["rude word", "inappropriate word"], ["banana", "noodle", "waffle"]),
    ("jizz", ["jazz", "jigsaw", "jamboree", "jalapeno"], ["rude word", "inappropriate word"], ["banana", "noodle", "waffle"]),
    ("spunk", ["spark", "spirit", "sparkle", "spatula"], ["courage", "determination", "grit"], ["banana", "noodle", "waffle"]),
    ("creampie", ["cream-soda", "creamsicle", "crayon-box"], ["dessert", "pastry", "treat"], ["banana", "noodle", "waffle"]),
    ("felch", ["festival", "felt-tip", "ferry-ride"], ["rude word", "inappropriate word"], ["banana", "noodle", "waffle"]),
    ("enema", ["enameled", "envelope", "encyclopedia"], ["medical procedure", "treatment"], ["banana", "noodle", "waffle"]),
    ("hooker", ["hookah", "hooligan", "bookend", "honey-hook"], ["jerk", "meanie", "rascal"], ["banana", "noodle", "waffle"]),
    ("blowjob", ["blow-dry", "blowfish", "blizzard", "blue-jay"], ["rude act", "inappropriate act"], ["banana", "noodle", "waffle"]),
    ("handjob", ["handstand", "handshake", "handball", "handiwork"], ["rude act", "inappropriate act"], ["banana", "noodle", "waffle"]),
    ("deepthroat", ["deep-thinker", "deep-dish", "deep-sea", "deep-freeze"], ["rude act", "inappropriate act"], ["banana", "noodle", "waffle"]),
    ("rimjob", ["rim-shot", "riddle", "rainbow", "river-dance"], ["rude act", "inappropriate act"], ["banana", "noodle", "waffle"]),
    ("footjob", ["foot-stool", "football", "footprint", "footloose"], ["rude act", "inappropriate act"], ["banana", "noodle", "waffle"]),
    ("titfuck", ["tiramisu", "tick-tock", "tiddly-pom"], ["rude act", "inappropriate act"], ["banana", "noodle", "waffle"]),
    ("tittyfuck", ["tiddlywinks", "tiramisu", "tickle-trunk"], ["rude act", "inappropriate act"], ["banana", "noodle", "waffle"]),
    ("sixtynine", ["sixty-eight", "sixty-something", "sixty-seven", "seventy-one"], ["rude number joke", "inappropriate joke"], ["banana", "noodle", "waffle"]),
    ("threesome", ["tricycle", "triple-scoop", "three-ring", "trifecta"], ["group activity", "party"], ["banana", "noodle", "waffle"]),
    ("orgy", ["orchard", "orca", "organ", "origami"], ["wild party", "ruckus"], ["banana", "noodle", "waffle"]),
    ("gangbang", ["gangplank", "gangway", "gong-show", "gallery"], ["rude act", "inappropriate act"], ["banana", "noodle", "waffle"]),
    ("bareback", ["horseback", "hobby-horse", "horse-ride", "pony-ride"], ["risky", "careless", "unprotected"], ["banana", "noodle", "waffle"]),
    ("lolita", ["lollipop", "ladybug", "lullaby", "lantern"], ["inappropriate reference"], ["banana", "noodle", "waffle"]),
    ("shota", ["shortbread", "shotput", "showtime", "shuttle"], ["inappropriate reference"], ["banana", "noodle", "waffle"]),
    ("futanari", ["futon", "furniture", "future", "fuzzy"], ["inappropriate reference"], ["banana", "noodle", "waffle"]),
    ("yaoi", ["yogurt", "yellow", "yoyo", "yacht"], ["inappropriate reference"], ["banana", "noodle", "waffle"]),
    ("ecchi", ["echidna", "eclipse", "excalibur", "enchilada"], ["inappropriate reference"], ["banana", "noodle", "waffle"]),
    ("camgirl", ["camper", "campfire", "cameo", "camera-shy"], ["inappropriate reference"], ["banana", "noodle", "waffle"]),
    ("camslut", ["camp-stove", "candy-stripe", "camera-shy"], ["inappropriate reference"], ["banana", "noodle", "waffle"]),
    ("camwhore", ["camp-ground", "canopy", "camouflage"], ["inappropriate reference"], ["banana", "noodle", "waffle"]),
    ("erotic", ["aromatic", "exotic", "electric", "energetic"], ["inappropriate", "rude"], ["banana", "noodle", "waffle"]),
    ("naked", ["noodle", "napping", "nifty", "nest"], ["undressed", "unclothed"], ["banana", "noodle", "waffle"]),
    ("topless", ["top-hat", "topspin", "topaz", "topsy-turvy"], ["inappropriate"], ["banana", "noodle", "waffle"]),
    ("upskirt", ["upside-down", "uplifting", "upbeat", "upgrade"], ["inappropriate"], ["banana", "noodle", "waffle"]),
    ("flasher", ["flashlight", "flashcard", "flash-dance", "flannel"], ["rude person", "troublemaker", "pest"], ["banana", "noodle", "waffle"]),
    ("lingerie", ["leotard", "long-johns", "lumber-jacket", "laundry"], ["undergarments", "sleepwear"], ["banana", "noodle", "waffle"]),
    ("femdom", ["femur", "fender", "festival", "fern"], ["rude reference"], ["banana", "noodle", "waffle"]),
    ("strapon", ["straw", "strap", "streamer", "stroller"], ["rude reference"], ["banana", "noodle", "waffle"]),
    ("pegging", ["pogo-stick", "peg-leg", "penguin", "peanut-butter"], ["rude reference"], ["banana", "noodle", "waffle"]),
    ("footfetish", ["footloose", "footprint", "football", "foot-stool"], ["rude reference"], ["banana", "noodle", "waffle"]),
    ("kink", ["kite", "kitten", "kiwi", "kale"], ["unusual preference"], ["banana", "noodle", "waffle"]),
    ("kinky", ["kooky", "kaleidoscopic", "kind-hearted"], ["unusual"], ["banana", "noodle", "waffle"]),
    ("fetish", ["festival", "feather", "fettuccine", "ferret"], ["unusual preference"], ["banana", "noodle", "waffle"]),
    ("bdsm", ["bobsled", "basketball", "butterscotch"], ["rude reference"], ["banana", "noodle", "waffle"]),
    ("bondage", ["bandage", "bon voyage", "boulder", "bouquet"], ["rude reference"], ["banana", "noodle", "waffle"]),
    ("bimbo", ["bambino", "bamboo", "barracuda", "bubblegum"], ["ditz", "airhead", "flibbertigibbet"], ["banana", "noodle", "waffle"]),
    ("dyke", ["dike", "dime", "dinosaur", "dipstick"], ["jerk", "bully", "meanie"], ["banana", "noodle", "waffle"]),
    ("milf", ["moth", "miniature", "marshmallow", "muffin"], ["rude reference"], ["banana", "noodle", "waffle"]),
    ("rape", ["grape", "rope", "drape", "scrape"], ["terrible act", "crime", "serious offense"], ["banana", "noodle", "waffle"]),
    ("pedophile", ["pedometer", "pelican", "pencil", "pedestrian"], ["terrible person", "criminal", "monster"], ["banana", "noodle", "waffle"]),
    ("incest", ["insect", "instrument", "ice-cream", "interlude"], ["terrible act", "crime"], ["banana", "noodle", "waffle"]),
    ("beastial", ["festival", "bicycle", "butterscotch", "broccoli"], ["inappropriate", "rude"], ["banana", "noodle", "waffle"]),
    ("bestial", ["festival", "bicycle", "butterscotch", "broccoli"], ["inappropriate", "rude"], ["banana", "noodle", "waffle"]),
    ("molest", ["moustache", "molecule", "muffin", "merry-go-round"], ["bother", "pester", "harass"], ["banana", "noodle", "waffle"]),
    ("apeshit", ["banana-split", "ape-escape", "acrobatics", "applesauce"], ["crazy", "wild", "freaking out"], ["primate-pudding", "noodle-explosion"]),
    ("bugger", ["badger", "bugle", "butterfly", "bubblegum"], ["bother", "pest", "nuisance"], ["banana", "noodle", "waffle"]),
    ("dipshit", ["dipstick", "dimpling", "dippity-doo", "dill-pickle"], ["nitwit", "dolt", "blockhead"], ["banana-brain", "potato-head"]),
    ("faggot", ["fajita", "falcon", "festival", "fidget"], ["jerk", "bully", "meanie"], ["banana", "noodle", "waffle"]),
    ("jerkoff", ["jogger", "jester", "jack-in-the-box", "jamboree"], ["goofball", "fool", "show-off"], ["banana", "noodle", "waffle"]),
    ("limpdick", ["limp-noodle", "lima-bean", "limber-lemur", "licorice"], ["wimp", "pushover", "weakling"], ["banana", "noodle", "waffle"]),
    ("prick", ["praline", "pretzel", "pickpocket", "pogo-stick"], ["jerk", "meanie", "rude person"], ["banana", "noodle", "waffle"]),
    ("pimp", ["prince", "piper", "pogo", "pumpernickel"], ["bully", "exploiter", "rascal"], ["banana", "noodle", "waffle"]),
    ("bollox", ["bologna", "bordeaux", "broccoli", "bubblegum"], ["nonsense", "rubbish", "hogwash"], ["banana", "noodle", "waffle"]),
    ("pieceofshit", ["piece-of-cake", "piece-of-pie", "piece-of-candy"], ["junk", "garbage", "trash"], ["banana-split", "noodle-soup"]),
]
SUBSTITUTION_CATEGORIES = ("silly", "polite", "random")
MONKEYS = ("🙈", "🙉", "🙊")

# --- Fixed values: roots tried in this order for compound words --------------
SUBSTITUTION_ROOTS = """
bullshit, horseshit, clusterfuck, motherfuck, mothafuck, muthafuck, mutherfuck,
goddamn, godamn, goddam, godam, fucking, fucker, fuck, shithead, shit, asshole,
asshat, ass, arse, bitch, cunt, dick, cock, damn, hell, piss, whore, slut,
bastard, crap, twat, wank, bollock, bollok, pussy, nigg
"""

# --- Fixed values: languages -------------------------------------------------
LANGUAGE_ALIASES = """
en: en, eng, english, en-us, en-gb, en-au
es: es, spa, spanish, es-es, es-mx, es-la
fr: fr, fre, fra, french, fr-fr, fr-ca
de: de, ger, deu, german, de-de
pt: pt, por, portuguese, pt-br, pt-pt
it: it, ita, italian
ja: ja, jpn, japanese
ko: ko, kor, korean
zh: zh, chi, zho, chinese, zh-cn, zh-tw
ar: ar, ara, arabic
ru: ru, rus, russian
"""
LANGUAGE_NAMES = """
en: English
es: Spanish
fr: French
de: German
it: Italian
pt: Portuguese
ru: Russian
ja: Japanese
ko: Korean
zh: Chinese
zh-cn: Chinese (Simplified)
zh-tw: Chinese (Traditional)
ar: Arabic
hi: Hindi
nl: Dutch
pl: Polish
sv: Swedish
da: Danish
fi: Finnish
no: Norwegian
tr: Turkish
id: Indonesian
th: Thai
vi: Vietnamese
cs: Czech
hu: Hungarian
ro: Romanian
el: Greek
he: Hebrew
uk: Ukrainian
bg: Bulgarian
hr: Croatian
sk: Slovak
sl: Slovenian
ms: Malay
ta: Tamil
te: Telugu
ml: Malayalam
bn: Bengali
ur: Urdu
fa: Persian
lt: Lithuanian
lv: Latvian
et: Estonian
"""

# --- Fixed values: label patterns --------------------------------------------
SDH_LABELS = [r"\bsdh\b", r"\bcc\b", r"\bclosed.?captions?\b", r"\bhearing.?impaired\b", r"\bdeaf\b", r"\bhi\b"]
FORCED_LABELS = [r"\bforced\b", r"\bforeign.?only\b", r"\bnarrative\b"]

# --- Fixed values: URL rules --------------------------------------------------
SUBTITLE_EXTENSIONS = ["vtt", "srt", "ass", "ssa", "sub"]
FONT_EXTENSIONS = ["otf", "ttf", "woff", "woff2", "eot"]
MODULE_EXTENSIONS = ["mjs", "cjs"]
SUBTITLE_QUERY_KEYS = ["subtitle", "subs", "captions"]
SUBTITLE_PATHS = r"/subtitles?/|/subs?/|/cc/|\.(?:vtt|srt|ass|ssa)\z|manifest=.*\.vtt"

# --- Fixed values: sites (name, pattern, tested against host or whole URL) ----
SITE_PATTERNS = [
    ("lookmovie", r"lookmovie\d*\.to"),
    ("lookmovie", r"lookmovie\.[a-z]+"),
    ("lookmovie", r"lookmovie\d*\.[a-z]+"),
    ("youtube", r"youtube\.com"),
    ("youtube", r"youtu\.be"),
    ("youtube", r"youtube-nocookie\.com"),
    ("123chill", r"123chill\.uk"),
    ("123chill", r"123chill\.[a-z]+"),
    ("123chill", r"123movies\.uk"),
    ("plutotv", r"pluto\.tv"),
    ("plutotv", r"plutotv\.com"),
    ("fmovies", r"fmovies\.[a-z]+"),
    ("fmovies", r"fmovies\d*\.[a-z]+"),
    ("fmovies", r"fmovie\.[a-z]+"),
    ("jellyfin", r"^https?://localhost:\d+/web"),
    ("jellyfin", r"^https?://127\.0\.0\.1:\d+/web"),
    ("jellyfin", r"^https?://[\w.-]+:\d+/web"),
    ("jellyfin", r"^https?://[\w.-]+:8096"),
    ("jellyfin", r"/web/.*[#&]?videoId="),
    ("cinebto", r"cinebto\.[a-z]+"),
    ("cinebto", r"cineb\.[a-z]+"),
    ("cinebto", r"111movies\.[a-z]+"),
    ("cinebto", r"111movies"),
    ("cinebto", r"twasmerelyhers\.[a-z]+"),
    ("2embed", r"2embed\.(org|cc|dev|io|net|xyz)"),
    ("2embed", r"2embed\.club"),
    ("2embed", r"2embed\.link"),
    ("2embed", r"2embeds?\.[a-z]+"),
    ("fandango", r"athome\.fandango\.com"),
    ("fandango", r"fandangoathome\.[a-z]+"),
    ("fandango", r"vudu\.com"),
    ("fandango", r"cc\.vudu\.com"),
]
SITE_ENDPOINTS = [
    ("lookmovie", "/api/v1/security/movie-access"),
    ("lookmovie", "/api/v2/download/"),
    ("youtube", "/api/timedtext"),
    ("youtube", "/caption/"),
]
# (server, pattern in the embed URL), best first
VIDEO_SERVERS = [
    ("vidsrcto", r"vidsrc\.mov/embed"),
    ("vidsrc-wtf-1", r"vidsrc\.[a-z]+/embed"),
    ("vidsrc-wtf-2", r"vidsrc\.[a-z]+/embed"),
    ("vidsrc-wtf-3", r"vidsrc\.[a-z]+/embed"),
    ("vidzee", r"vidzee"),
    ("vidrock", r"vidrock"),
    ("vidnest", r"vidnest"),
    ("riveembed", r"riveembed"),
    ("smashystream", r"smashystream"),
    ("111movies", r"111movies"),
    ("videasy", r"videasy"),
    ("vidlink", r"vidlink"),
    ("vidfast", r"vidfast"),
    ("embedsu", r"embed\.su"),
    ("2embed", r"2embed"),
    ("moviesapi", r"moviesapi"),
    ("autoembed", r"autoembed"),
    ("multiembed", r"multiembed"),
    ("vidsrc-xyz", r"vidsrc\.xyz"),
    ("primewire", r"primewire"),
    ("warezcdn", r"warezcdn"),
    ("superflix", r"superflix"),
    ("vidup", r"vidup"),
]

# --- Fixed values: sources and how their cues replace older ones --------------
USER_SOURCES = ["user-upload", "user-selection"]
CHOSEN_SOURCES = ["lookmovie.user-subtitle-selected", "lookmovie.auto-selected"]
SAME_SITE_SOURCES = ["youtube-intercepted", "youtube"]
SYNCED_REPLACE_SOURCES = ["fmovies", "wyzie"]
SYNCED_SEGMENT_SOURCES = ["fmovies", "Wyzie", "Video Track", "plutotv-texttracks"]

# --- Fixed values: default settings -------------------------------------------
DEFAULT_PROFILE = {
    "enabled": True,
    "offset_ms": 0,
    "sensitivity": "medium",
    "fuzzy_threshold": 0.25,
    "preferred_language": "en",
    "prefer_sdh": True,
    "auto_select_track": True,
    "use_substitutions": True,
    "substitution_category": "monkeys",
    "show_upcoming": False,
    "show_flagged_only": False,
    "upcoming_count": 2,
}


def words_of(block: str) -> list[str]:
    """Split one of the comma-separated blocks above into its entries."""
    return [w for w in (" ".join(p.split()) for p in block.split(",")) if w]


def pairs_of(block: str) -> list[tuple[str, str]]:
    """Split one of the ``key: value`` blocks above into its rows."""
    rows = (line.split(":", 1) for line in block.strip().splitlines())
    return [(k.strip(), v.strip()) for k, v in rows]
