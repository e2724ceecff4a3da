"""The word lists of the features and of the annotator."""

PLACE_ADVERBS = "above abroad ahead around behind below downstairs everywhere far here indoors inside near nearby nowhere outdoors outside there upstairs".split()
TIME_ADVERBS = "afterwards already always before early eventually frequently late later long next often rarely sometimes soon still then today tomorrow yesterday".split()
FIRST_PERSON = "i me myself ourselves us we".split()
SECOND_PERSON = "you yourself yourselves".split()
THIRD_PERSON = "he her herself him himself it itself she them themselves they".split()
DEMONSTRATIVES = "that these this those".split()
INDEFINITES = "all another any anybody anyone anything both each either everybody everyone everything few many most neither nobody none nothing one others several some somebody someone something".split()
PERFECT_SKIP_POS = "ADP ADV CCONJ DET PART PRON PUNCT SCONJ".split()
PERFECT_SKIP = "n't never no not".split()
WH_WORDS = "how what when where which who whom whose why".split()
NOMINAL_SUFFIXES = "al ance ence ery hood ity ment ness ship sion tion ure".split()
PASSIVE_SKIP_POS = "ADV CCONJ DET PART PRON PUNCT SCONJ".split()
NEGATIONS = "n't never not".split()
CONJUNCTS = "afterward afterwards besides consequently furthermore hence however instead meanwhile moreover nevertheless nonetheless otherwise therefore thus".split()
DOWNTONERS = "barely hardly mildly moderately rather slightly somewhat".split()
HEDGES = "about almost approximately around generally nearly roughly virtually".split()
AMPLIFIERS = "absolutely extremely highly really so super too totally truly very".split()
EMPHATICS = "certainly clearly definitely frankly indeed obviously surely".split()
DISCOURSE = "anyway now so well".split()
POSSIBILITY = "can could may might".split()
NECESSITY = "must ought should".split()
NECESSITY_MORE = "have need".split()
PREDICTION = "shall will would".split()
PUBLIC_VERBS = "acknowledge add admit announce claim declare explain maintain mention proclaim recount reply say state".split()
PRIVATE_VERBS = "believe doubt estimate expect fear forget hope imagine know remember suppose think understand".split()
SUASIVE_VERBS = "advise ask command demand enjoin forbid insist order permit propose recommend suggest urge".split()
SEEM_VERBS = "appear look seem".split()
CLAUSE_STARTS = "also and but or plus so then".split()
CONTENT_POS = "ADJ ADV NOUN PROPN VERB".split()
DEATH = "assassinate dead death die execute homicide kill murder slain slaughter slay suicide".split()
SEX = "breast breasts cock dick fuck penis pussy rape sex sexual sexuality vagina".split()
NARRATOR = "i me mine my our ours us we".split()
SPEECH_VERBS = "admit announce answer argue ask believe claim confess explain murmur note promise remark remember reply say shout state suggest tell think warn whisper yell".split()
#: Phrases that count once per sentence, by class.
PHRASES = {
    "conjuncts": r"\b(?:as a result|on the other hand|in contrast)\b",
    "downtoners": r"\b(?:a little|a bit|kinda)\b",
    "hedges": r"\b(?:more or less|kind of|sort of)\b",
    "amplifiers": r"\bby far\b",
    "emphatics": r"\bfor sure\b",
    "causal": r"\b(?:because|since|as|now that|seeing that)\b",
    "concessive": r"\b(?:although|even though|though|whereas|even if)\b",
    "conditional": r"\b(?:if|unless|provided that|providing(?: that)?|as long as|in case)\b",
    "other": r"\b(?:when|while|after|before|until|once|so that|in order that|as soon as)\b",
}

#: Irregular forms by lemma.
IRREGULAR = {
    "be": "am are be been being is was were", "have": "had has have having", "do": "did do does doing done", "get": "get gets getting got gotten",
    "say": "said say says", "know": "knew know known knows", "think": "think thinks thought", "tell": "tell tells told", "go": "go goes going gone went",
    "see": "saw see seen sees", "take": "take taken takes took", "die": "die died dies dying", "slay": "slay slays slew", "understand": "understand understands understood",
    "forget": "forget forgets forgot forgotten", "forbid": "forbade forbid forbidden forbids", "i": "i", "this": "this", "his": "his", "us": "us", "as": "as", "its": "its", "yes": "yes",
}
PRONOUNS = "i me my mine myself we us our ours ourselves you your yours yourself he him his himself she her hers herself it its itself they them their theirs themselves who whom whose what".split()
DETERMINERS = "a an the this that these those each every some any no which".split()
ADPOSITIONS = "about above across after against along among around at before behind below by down during for from in into near of off on onto over through toward towards under until up upon with within without".split()
SUBORDINATORS = "although because if lest since than though unless whereas whether while when where how why".split()
MODALS = "can could may might must ought shall should will would".split()
ADVERBS = "again already also always away even ever far here however just more most never nevertheless now often once only perhaps quite rather seldom so soon still then there therefore thus today together tomorrow too very well yesterday almost indeed instead meanwhile moreover somewhat about".split()
VERBS = "acknowledge add admit advise announce answer appear argue ask assassinate believe claim command confess declare demand doubt enjoin estimate execute expect explain fear forbid forget get go hope imagine insist kill know look maintain mention murder murmur note order permit proclaim promise propose recommend recount remark remember reply say see seem shout slay state suggest suppose take tell think understand urge warn whisper yell".split()
PARTICIPLES = "been done gone seen taken known gotten forgotten forbidden said told thought understood slain written given made found".split()
COORDINATORS = "and but nor or".split()
NUMBER_WORDS = "zero one two three four five six seven eight nine ten hundred thousand million".split()
SYMBOLS = list("$+<=>^`|~")
PAST_FORMS = "was were had did said went saw knew thought told took".split()
NOUN_ENDS = "tion sion ment ness ity ship hood ance ence".split()
ADJECTIVE_ENDS = "ous ful ive able ible ish less".split()
QUOTE_CHARS = frozenset("\"'“”‘’«»„‚‹›")
