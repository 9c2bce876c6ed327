"""Problem 1: abusive, hateful or sexual content, by a weighted finite-state pattern grammar.

Three transducers are composed, lazily and determinized as texts need it:

- the lexical one turns each token into the words and word classes it can stand for, each with a weight, also when it is disguised
  (signs for letters, masked letters, stretched or separated letters, swapped neighbours, one wrong letter in a long word);
- the clause grammar accepts insults, threats, dehumanizing and sexual clauses built from roles (who is addressed, copula, intent, verb,
  part of the body or relative, group, place). A clause weighs its rule's weight and those of its words, so that a word with harmless senses
  ("pig") needs a clause that leaves no doubt ("shut up, pig"), while "idiot" needs only an address;
- the context one follows negation and talk about words: a clause that starts in such a context weighs nothing, nor does one that
  is reported right after ("..., he said").

A text's score is the sum, over categories, of the heaviest clause matched. Isolated words never score. Clauses of English, German,
Spanish and French are known.

Defined results: null, empty and blank texts score 0 with no category; repeated rows get the same score each; a
text of any length is read whole; further columns are kept by `score` columns and not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A clause or text of this score counts as abusive: an address (2) of a mild insult (2), say.
THRESHOLD = 4.0

#: Word classes of the grammar: weight, words.
CLASSES = {
    # insults that have no harmless sense for a person, and those that have
    "N": (3.0, "idiot idiots moron morons imbecile imbeciles cretin cretins dimwit halfwit scumbag scumbags dumbass dumbasses bastard bastards bitch bitches asshole assholes arsehole cunt cunts twat wanker prick dickhead "
          "shithead motherfucker douchebag slut whore retard faggot lowlife degenerate nitwit simpleton dunce weakling crybaby bootlicker pervert fuckwit scum subhuman subhumans whores sluts cunts pricks wankers twats retards dickheads perverts faggots motherfuckers degenerates lowlifes"),
    "M": (2.0, "loser losers coward cowards fraud frauds parasite parasites pig pigs clown clowns fool fools jerk jerks trash garbage rat rats snake snakes weasel weasels leech leeches creep creeps freak freaks slob liar liars failure "
          "waste disgrace dog dogs cow animal animals cockroach vermin filth swine toad maggot worm joke monster monsters twit hag skank tramp psycho"),
    "V": (2.0, "loser coward fraud parasite pig clown fool jerk rat snake weasel leech creep freak slob liar twit losers cowards pigs clowns rats trash scum"),
    "A": (1.5, "stupid worthless useless pathetic disgusting vile filthy spineless brainless repulsive revolting gutless"),
    "B": (1.0, "dumb ugly rotten miserable clueless ignorant hideous sick wretched nasty dirty fat lying cheating fucking damn bloody greasy smelly"),
    "DEHUM": (3.0, "vermin subhuman subhumans cockroaches filth scum savages maggots lice parasites"),
    "PLAGUE": (2.0, "plague cancer disease infestation stain disgrace leeches parasites virus"),
    "BEAST": (2.0, "animals rats trash pests garbage dogs pigs apes monkeys snakes thieves criminals inferior worthless disgusting filthy vile evil monsters rapists"),
    # violence
    "KILL": (3.0, "kill murder strangle stab shoot behead gut lynch rape slaughter butcher execute kills murders strangles stabs shoots rapes"),
    "HURT": (2.0, "hurt hurts punch punches stomp stomps choke chokes drown drowns hang hangs break breaks smash smashes burn burns slap slaps kick kicks bash whip cripple maim cut cuts slit slits snap snaps rip rips bury buries"),
    "BEAT": (1.5, "beat beats crush crushes destroy destroys hit hits end ends finish ruin slay"),
    "DONE": (2.0, "beaten killed hurt shot stabbed burned burnt hanged hung murdered smashed punched slapped whipped choked strangled drowned crushed raped beheaded lynched kicked stomped"),
    "DIE": (2.0, "die choke rot suffer burn drown bleed hang perish dies chokes rots suffers burns drowns bleeds hangs croak"),
    "BODY": (0.5, "legs leg neck face bones arms arm skull teeth fingers knees knee head jaw nose throat eyes ribs guts heart spine kneecaps hands"),
    "KIN": (0.5, "family mother mom mum father dad kids children wife husband sister brother dog cat parents son daughter house"),
    "EXPEL": (3.0, "exterminated eradicated gassed sterilized sterilised purged hanged lynched slaughtered castrated"),
    "BANISH": (2.0, "deported expelled shot jailed banned removed"),
    "GROUP": (1.0, "immigrants migrants foreigners refugees muslims jews christians hindus arabs africans asians mexicans blacks whites gays lesbians homosexuals transgenders gypsies women men girls peasants natives outsiders disabled atheists indians"),
    "PLACE": (1.0, "schools school streets street children kids country countries town neighbourhood neighborhood city village homes jobs land nation society humanity planet daughters women churches"),
    # sexual
    "NUDE": (2.0, "nudes nude naked topless undressed"),
    "PRIVATE": (2.0, "boobs tits dick cock pussy ass cunt penis vagina nipples genitals arse"),
    "PICS": (1.0, "pics pictures photos videos vids pic cams selfies video photo clips"),
    "LEWD": (1.0, "lick kiss touch taste fondle grope caress stroke undress spank"),
    "SEX": (3.0, "fuck sext shag masturbate"),
    # grammar words
    "ARE": (0.0, "are is am be r"),
    "WERE": (-1.0, "was were"),
    "YOU": (0.0, "you u ya yall"),
    "YOUR": (0.0, "your ur yer"),
    "DET": (0.0, "a an the such one another some"),
    "ADV": (0.5, "so such just really very totally absolutely damn complete total utter absolute truly fucking bloody nothing but literally all always still"),
    "SOON": (0.0, "will shall gonna going want wanna must to swear promise coming about ready"),
    "ILL": (0.0, "i'll we'll lemme gonna ill imma"),
    # other languages, without accents
    "DE_N": (3.0, "idiot idiotin vollidiot trottel arschloch dummkopf schwachkopf hurensohn wichser missgeburt abschaum schlampe hure drecksack mistkerl fotze spast drecksau vollpfosten bastard idioten vollidioten hurensohne arschlocher schlampen huren"),
    "DE_M": (2.0, "versager depp feigling schwein ratte clown lugner penner loser esel hund null parasit"),
    "DE_A": (1.5, "dumme dummer dummes dreckige dreckiger dreckiges elende elender elendes blode bloder blodes nutzlose nutzloser erbarmliche erbarmlicher widerliche widerlicher wertlose wertloser hasslicher hassliche verdammter verdammte"),
    "DE_P": (2.0, "dumm blod erbarmlich widerlich wertlos nutzlos ekelhaft abartig"),
    "DE_V": (3.0, "umbringen toten erschiessen abstechen verprugeln erwurgen schlagen vernichten zusammenschlagen"),
    "DE_D": (3.0, "ungeziefer abschaum untermenschen parasiten dreck ratten schweine schmarotzer kakerlaken"),
    "ES_N": (3.0, "idiota idiotas imbecil imbeciles gilipollas cabron cabrona pendejo pendeja puta puto mierda hijoputa subnormal maricon zorra estupido estupida capullo escoria malnacido"),
    "ES_M": (2.0, "inutil basura cerdo cerda rata perdedor perdedora payaso payasa tonto tonta cobarde asqueroso asquerosa fracasado fracasada patetico patetica asco parasito"),
    "ES_V": (3.0, "matar romper golpear partir degollar reventar estrangular apunalar destrozar matarte romperte golpearte reventarte partirte"),
    "ES_D": (3.0, "basura escoria ratas parasitos alimanas plaga cucarachas subhumanos mierda"),
    "FR_N": (3.0, "idiot idiote imbecile connard connasse salope encule cretin cretine abruti abrutie debile ordure pourriture merde salaud pute batard con conne bouffon pouffiasse"),
    "FR_M": (2.0, "minable rate ratee lache porc chien clown menteur menteuse nul nulle parasite inutile pathetique rat dechet"),
    "FR_V": (3.0, "tuer frapper casser buter crever egorger etrangler massacrer detruire defoncer"),
    "FR_D": (3.0, "vermine rats parasites dechets cafards ordures nuisibles pourriture racaille"),
}
#: Words that can follow a complete clause: with one of these, or a sign, the clause has ended.
ENDING = (
    "and or but so because if when while that who which what why how where then than as since until although though before after for with without on in at by from of to i you he she it we they me him her us them my your his "
    "our their this these those there here the a an no not never every everyone everybody nobody somebody someone one all both just only now today tonight again please lol honestly is are was were will would should can could did do does "
    "und oder aber weil wenn dass der die das ich du er sie es wir ihr mein dein auch nicht y o pero porque si que el la los las un una yo tu no te me et ou mais parce que le les une je il elle nous vous pas ne"
).split()

#: category, weight, pattern. Words stand for themselves, UPPER case for classes, _ for any word; after an item: ? optional, * any number, + one or more;
#: {a|b} alternatives, _n up to n words of any kind, # an account name, END a sign or a word of ENDING, STOP the end of a sentence.
RULES = [
    # a person is addressed
    ("insult", 2, "YOU N"),
    ("insult", 2, "YOU {ADV|A|B}+ {N|M}"),
    ("insult", 2, "YOU V END"),
    ("insult", 2, "YOU {ARE|WERE} {DET|ADV|A|B}* N"),
    ("insult", 2, "YOU {ARE|WERE} {DET|ADV|B}* A {DET|ADV|A|B}* M"),
    ("insult", 2, "YOU {ARE|WERE} {DET|ADV|B}* M END"),
    ("insult", 2, "{you're|youre} {DET|ADV|A|B}* N"),
    ("insult", 2, "{you're|youre} {DET|ADV|B}* A {ADV|A|B}* M"),
    ("insult", 2, "{you're|youre} {DET|ADV|B}* M END"),
    ("insult", 1, "YOUR DET? {ADV|A|B}* N END"),
    ("insult", 1, "YOUR DET {ADV|B}* A {ADV|A|B}* M END"),
    ("insult", 2.5, "{YOU ARE|YOU WERE|you're|youre} {ADV|A}* A END"),
    ("insult", 2.5, "{YOU ARE|you're|youre} {ADV|B}* ADV B END"),
    ("insult", 2, "what {DET|ADV}? {ADV|A|B}* {N|M} YOU {ARE|WERE}"),
    ("insult", 1, "what {DET|ADV} {ADV|A|B}* N END"),
    ("insult", 2, "what a {bunch|lot|pack|load} of {ADV|A|B}* {N|M} YOU ARE"),
    ("insult", 2, "shut {up|it|your} YOU? {ADV|A|B}* {N|M}"),
    ("insult", 3, "shut your _? {mouth|trap|face|hole} YOU? {N|M|END}"),
    ("insult", 1.5, "{silence|listen|hey|oi|ugh|bye|quiet} YOU? {ADV|A|B}+ {N|M} END"),
    ("insult", 1, "{silence|listen|hey|oi|ugh|bye|quiet} YOU? N END"),
    ("insult", 4, "fuck {off|YOU}"),
    ("insult", 4, "{screw|damn} {you|YOU} END"),
    # a person is spoken of
    ("insult", 2, "# {ARE|WERE} {DET|ADV|A|B}* N"),
    ("insult", 2, "# {ARE|WERE} {DET|ADV|A|B}* M END"),
    ("insult", 2.5, "# ARE {ADV|A}* A END"),
    ("insult", 2, "{he|she} {ARE|WERE} {ADV|A|B}* DET {ADV|A|B}* N END"),
    ("insult", 2, "{he's|she's} {ADV|A|B}* DET {ADV|A|B}* N END"),
    ("insult", 2, "{he|she} ARE ADV* DET {ADV|B}* {A|M} {ADV|A|B}* M END"),
    ("insult", 2, "{he|she} ARE DET {ADV|A|B}* M END"),
    ("insult", 1.5, "{they|those|these} _? ARE {ADV|B}* A* {N|M} STOP"),
    ("insult", 1, "only DET {A|B}* {N|M} would"),
    ("insult", 1.5, "only DET A {A|B}* {N|M} would"),
    ("insult", 4, "{nobody|noone} {{likes|loves|misses} YOU|{wants|needs} YOU {STOP|here|around}|cares about YOU}"),
    ("insult", 2.5, "{A|B|YOU|N|such|complete|absolute|total}? waste of {oxygen|space|air|breath|skin|life|time} END"),
    ("insult", 2.5, "A {A|B}* waste of {oxygen|space|air|breath|skin}"),
    ("insult", 4, "waste of {oxygen|breath|skin}"),
    ("insult", 4, "do {us|everyone|me|the} _3 {favour|favor} and {disappear|vanish|die|leave|drop|jump}"),
    ("insult", 4, "{better|happier|good|nicer|best} _3 if YOU {had|were|was} never {been|existed}? born?"),
    ("insult", 4, "{if|wish|wished} YOU {had|were|was} never been born"),
    ("insult", 4, "YOU should never have been born"),
    ("insult", 4, "{wish|wished} YOU {were|was} {dead|gone|never}"),
    ("insult", 4, "better {off|place} without YOU END"),
    ("insult", 4, "YOUR kind {makes|make|disgusts|ruins} _5 {sick|puke|vomit|everything|it}"),
    ("insult", 4, "{people|women|men|things} like YOU {make|disgust|ruin|are|should|sicken|deserve}"),
    ("insult", 4, "YOUR kind disgusts"),
    ("insult", 4, "YOU {make|makes} {me|us|everyone} {sick|puke|vomit}"),
    ("insult", 4, "YOU disgust {me|us|everyone}"),
    ("insult", 4, "crawl back {under|to|into|in} {YOUR|the|that|whatever}"),
    ("insult", 4, "{eat|suck|lick} {shit|dirt|it|my} {YOU|N|boots|ass|balls|END}"),
    ("insult", 2.5, "{YOU ARE|you're|youre} {DET|ADV|A|B}* {piece|pile|bag|sack|heap|excuse|lump} of {ADV|A|B}* {N|M|shit|crap|dirt}"),
    ("insult", 4, "{YOU ARE|you're|youre} {so|even|far}? {dumber|stupider|uglier|worse|dirtier} than"),
    ("insult", 4, "YOU make me want to {puke|vomit|throw|scream}"),
    ("insult", 1, "YOUR KIN ARE {DET|ADV|A|B}* N"),
    ("insult", 2, "{they|these|those} ARE all {ADV|A|B}* {N|M} END"),
    ("insult", 4, "drop dead STOP"),
    ("insult", 1, "die YOU? {ADV|A|B}* N END"),
    # violence
    ("threat", 2.5, "YOUR KIN {deserve|deserves} to DIE"),
    ("threat", 2, "{someone|somebody} {should|must|needs|ought|has|oughta} to? _1 {KILL|HURT} {YOU|him|her|them}"),
    ("threat", 2.5, "YOU {deserve|deserved} to {be|get} DONE"),
    ("threat", 2.5, "YOU deserve {it|to|nothing} DIE"),
    ("threat", 2.5, "YOU deserve to DIE"),
    ("threat", 2.5, "{hope|wish|pray} {someone|somebody|they|he|she|god|karma} {KILL|HURT|BEAT} {YOU|YOUR} BODY?"),
    ("threat", 2.5, "{hope|wish|pray} YOU all? DIE"),
    ("threat", 2.5, "{hope|wish|pray} YOUR {KIN|whole|entire} _2 DIE"),
    ("threat", 2.5, "{hope|wish|pray} YOU get {DONE|hit|cancer|hurt|sick}"),
    ("threat", 4.5, "{hope|wish} YOU get {cancer|aids|raped}"),
    ("threat", 2.5, "{someone|somebody|they|we|i} {should|must|ought|will|oughta} _2 {KILL|HURT} {YOU|YOUR} END?"),
    ("threat", 2, "{i|we|i'm|im|we're} SOON+ _1 {KILL|HURT} YOU"),
    ("threat", 2, "ILL _1 {KILL|HURT} YOU"),
    ("threat", 2, "{i|we|i'm|im|we're} SOON+ _1 {KILL|HURT} YOUR {KIN|BODY}"),
    ("threat", 2, "ILL _1 {KILL|HURT} YOUR {KIN|BODY}"),
    ("threat", 3, "{{i|we|i'm|im} SOON+|ILL} _1 BEAT {YOUR|YOU} {BODY|KIN|up|senseless|bloody}"),
    ("threat", 3, "BEAT YOUR _1 {face|skull|teeth|head|ass|brains} in"),
    ("threat", 1.5, "{i|we} SOON+ KILL {him|her|them|all} END"),
    ("threat", 3, "{{i|we|i'm|im} SOON+|ILL} find YOU and _1 {KILL|HURT|BEAT}"),
    ("threat", 8, "i {will|shall|gonna} find YOU STOP"),
    ("threat", 8, "i'll find YOU STOP"),
    ("threat", 4, "{know|found|find} {out|exactly}? where YOU {live|sleep|work} STOP"),
    ("threat", 4.5, "go {and|please}? {die|choke|rot|drown|croak} {END|on|in}"),
    ("threat", 4.5, "go {hang|drown|gut} {yourself|urself}"),
    ("threat", 2.5, "go {KILL|HURT} yourself"),
    ("threat", 2, "{KILL|hang|drown} {yourself|urself|yourselves} END"),
    ("threat", 4, "go {jump|drive|walk|leap} off _2 {cliff|bridge|roof|building}"),
    ("threat", 4, "go {play|walk} {in|into} traffic"),
    ("threat", 2.5, "YOU {will|should|must|shall|gonna} all? {DIE STOP|{die|suffer|rot|bleed} END}"),
    ("threat", 4.5, "{rot|burn} in hell"),
    ("threat", 2.5, "{you'll|youll} all? DIE STOP"),
    ("threat", 4, "{YOU ARE|you're|youre} {so|a}? dead {meat|STOP}"),
    ("threat", 4, "watch YOUR back STOP"),
    ("threat", 2.5, "make YOU {DIE|bleed|beg|pay|scream} END"),
    ("threat", 4, "{come|coming|came} {for|after} YOU and YOUR"),
    ("threat", 4, "{put|bullet|knife} _3 {bullet|knife|blade} {in|into|through} YOUR"),
    ("threat", 4, "{bullet|knife|blade} {in|into|through} YOUR BODY"),
    # groups
    ("hate", 1, "all _2 {are|were} {ADV|B|DET|A|nothing|but}* DEHUM"),
    ("hate", 2.5, "all _2 are {ADV|B}* A END"),
    ("hate", 1, "{those|these|the} _2 are {ADV|B|DET|A|nothing|but}* DEHUM END"),
    ("hate", 1, "GROUP {are|were} {ADV|B|DET|A|nothing|but}* {DEHUM|BEAST|PLAGUE} {END|on|of|to}"),
    ("hate", 2, "{you|these|those|them} {people|lot|types|folk|folks|kind|freaks} {are|were} {ADV|B|DET|A|nothing|but}* {DEHUM|BEAST|PLAGUE} END"),
    ("hate", 1, "GROUP {are|were} {ADV|B|DET|A|nothing|but|all}* N END"),
    ("hate", 3.5, "{kick|throw|drive|get|keep} {all|the|every|those|these} {the|those|these|fucking|damn}? GROUP out"),
    ("hate", 4, "deport {them all|all of them|every|all GROUP|those GROUP|the GROUP}"),
    ("hate", 2, "{GROUP|they|people|those|these} _1 {is|are} {ADV|DET}* PLAGUE {on|of|to|in} {our|this|the|my} PLACE"),
    ("hate", 1, "{GROUP|they} {should|must|need} all? to? be? all? {EXPEL|BANISH} END"),
    ("hate", 1, "_ {should|must} all? be all? EXPEL"),
    ("hate", 4, "_ {should|must} all? be all? driven out"),
    ("hate", 3, "GROUP {should|must} all? be all? {wiped|kicked|thrown|chased|burned} {out|off}"),
    ("hate", 1, "{should|must} all? be all? {driven|BANISH|EXPEL} out? END they are {ADV|B}* {A|DEHUM|BEAST}"),
    ("hate", 1.5, "keep {those|these|the|all} {A|B|DEHUM|BEAST}+ _2 {away|out} {from|of} {our|my|the|this} PLACE"),
    ("hate", 2, "keep {those|these|the|all} GROUP {away|out} {from|of} {our|my|the|this} PLACE"),
    ("hate", 1, "never trust DET _2 DEHUM"),
    ("hate", 4, "never trust DET {GROUP|jew|muslim|gypsy|foreigner|immigrant|arab|black}"),
    ("hate", 4, "{subhuman|vermin|scum|filth|filthy|inferior|disgusting|worthless} {lot|race|breed|bunch|tribe|species|people} END"),
    ("hate", 4, "go back to YOUR {own|A|B}? {country|swamp|cave|land|jungle|desert|hole|continent}"),
    ("hate", 4, "go back to? where YOU {came|come|belong}"),
    ("hate", 3, "GROUP {don't|dont|shouldn't|should not|do not} {belong|deserve rights|breed|exist|vote|reproduce} {here|END}?"),
    ("hate", 3, "{i|we} {really|all|fucking}? {hate|despise|loathe} {all|every|these|those|fucking}? {the|of|those|these|fucking}? GROUP"),
    ("hate", 4, "death to {all|every|those|GROUP}"),
    ("hate", 2, "KILL {all|every|them|the|those} {the|of|those}? {GROUP|jews|muslims}"),
    ("hate", 3, "{filthy|dirty|fucking|disgusting|stinking} {jew|muslim|arab|gypsy|immigrant|foreigner|GROUP} {END|scum|pig|pigs|trash|filth}"),
    # sexual
    ("sexual", 3, "{send|show|share|give|gimme|dm|want|trade} {me|us|some|you|your|ur|my|more}? {YOUR|some|more|hot|my|me|those}? PRIVATE"),
    ("sexual", 5, "{send|show|share|give|gimme|dm|want|trade} {me|us|some|you|your|ur|my|more}? {YOUR|some|more|hot|my|me|those}? {nudes|nude}"),
    ("sexual", 3, "{wanna|want|you} {to}? {see|touch|taste|feel|suck} {my|YOUR|me} _? {NUDE|PRIVATE|naked}"),
    ("sexual", 2, "{hot|sexy|free|wild|horny|my|dirty}? {hot|sexy|free|wild|dirty}? NUDE PICS"),
    ("sexual", 3, "PICS of {me|my|us|YOUR} {NUDE|PRIVATE}"),
    ("sexual", 4.5, "{let's|lets|wanna|want to|come} have sex"),
    ("sexual", 1.5, "{someone|somebody|girl|guy|woman|man|anyone} to SEX"),
    ("sexual", 3, "{hot|sexy|dirty} PICS {in|on} my {profile|bio|dms|page|channel}"),
    ("sexual", 5, "{free|hot|live|amateur|best} {porn|sex|xxx}"),
    ("sexual", 5, "porn {by|of|with|here|link|videos|site}"),
    ("sexual", 5, "{watch|see} me {undress|naked|masturbate|cum|strip STOP}"),
    ("sexual", 4.5, "horny {and|for|tonight|now|here|STOP|girls|as|right}"),
    ("sexual", 4.5, "aroused {and|for|tonight|now|here}"),
    ("sexual", 2, "{who|wants|want|wanna|let's|lets|gonna|i'd|come} {wants|want}? to? SEX"),
    ("sexual", 4.5, "{want|wants|wanna|need} {some|have|to have}? sex {tonight|now|STOP|with}"),
    ("sexual", 2, "SEX {me|you|YOU} {tonight|hard|now|all|right|until|senseless|STOP|in}"),
    ("sexual", 2, "{i|i'd|id|wanna|want|gonna} _3 SEX {you|YOU}"),
    ("sexual", 4, "{LEWD|suck|kiss} every {inch|part|bit} of YOU"),
    ("sexual", 4, "{LEWD|suck|kiss} {every|YOUR|you} _3 {thighs|PRIVATE}"),
    ("sexual", 3, "{suck|ride|stroke|lick|eat|touch} {my|your|YOUR} _1 {PRIVATE|cock|balls}"),
    ("sexual", 4, "{dm|message|text|pm} me for {nudes|sex|fun|NUDE|hookup}"),
    # German
    ("insult", 2, "du {DE_A|A}* DE_N"),
    ("insult", 2, "du {DE_A}+ DE_M"),
    ("insult", 2, "{du bist|bist du|ihr seid|sie sind} {so|ein|eine|echt|einfach|doch|nur|wirklich|total|DE_A}* DE_N"),
    ("insult", 2, "{du bist|bist du} {so|ein|eine|echt|einfach|doch|nur|wirklich|total|DE_A}* DE_M END"),
    ("insult", 2, "{du bist|bist du} {so|echt|einfach|doch|nur|wirklich|total}* DE_P END"),
    ("insult", 4, "halt {die|deine} {fresse|schnauze}"),
    ("insult", 4, "verpiss dich"),
    ("threat", 4.5, "ich {bring|bringe} {dich|euch} {noch|alle}? um"),
    ("threat", 2, "ich {werde|will|wurde|werd} {dich|euch} _2 DE_V"),
    ("threat", 2, "ich {werde|will|werd} {deine|deinen} _1 _1 DE_V"),
    ("threat", 4, "ich {schlag|schlage|mach|mache|steche} {dich|dir} _2 {fertig|kaputt|ab|tot|ein|zusammen}"),
    ("threat", 4, "{hoffe|hoffentlich} {du|stirbst} {stirbst|verreckst|krepierst|du}"),
    ("threat", 4, "{geh|geht} {sterben|verrecken}"),
    ("hate", 1.5, "{auslander|juden|muslime|fluchtlinge|turken|frauen|zigeuner|migranten|schwarze} sind {nur|doch|wie|alle|ein}* DE_D"),
    ("insult", 2, "{ihr seid|sie sind} {so|alle|alles|echt|einfach|doch|nur|wirklich|DE_A}* {DE_N|DE_M} END"),
    ("hate", 1.5, "{alle|diese} _2 sind {nur|doch|wie|alle|ein}* DE_D"),
    ("hate", 4, "{auslander|fluchtlinge|juden|muslime} {raus|vergasen|abschieben}"),
    ("sexual", 4.5, "{schick|sende|zeig|schicke} mir _2 {nacktbilder|nacktfotos|titten|nudes}"),
    # Spanish
    ("insult", 2, "{eres|sos|sois} {un|una|tan|muy|el|la|mas|gran|puro|solo|todo|maldito|maldita}* ES_N"),
    ("insult", 2, "{eres|sos|sois} {un|una|tan|muy|el|la|mas|gran|pura|puro|solo|maldito|maldita}* ES_M END"),
    ("insult", 4, "hijo de {puta|perra}"),
    ("insult", 2, "{callate|cierra} {la|el}? {boca|pico}? {ES_N|ES_M}"),
    ("insult", 2, "{maldito|maldita|pedazo|puto|puta} {de}? {ES_N|ES_M}"),
    ("insult", 4, "{vete|iros|vayanse} a {la|tomar|chingar} {mierda|por|verga|tu}"),
    ("threat", 2, "{te|os|les} {voy|vamos} a ES_V"),
    ("threat", 2, "{voy|vamos} a ES_V {a|te|END|tu}?"),
    ("threat", 4, "{ojala|espero} _1 te {mueras|maten|pudras|ahogues}"),
    ("threat", 4, "te {mato|matare|rompo|parto|reviento}"),
    ("hate", 1.5, "{inmigrantes|moros|gitanos|judios|negros|extranjeros|refugiados|mujeres|maricones|migrantes} son {una|unos|unas|solo|puros|pura|todos}* ES_D"),
    ("hate", 1.5, "{todos|todas|esos|estos} {los|las}? _2 son {una|unos|unas|solo|puros|pura}* ES_D"),
    ("hate", 4, "{vuelve|vete|vuelvete|largate} a tu pais"),
    ("sexual", 4.5, "{manda|mandame|envia|enviame|pasame} {me|tus|fotos|unas}* {nudes|desnuda|desnudo|desnudos|tetas}"),
    # French
    ("insult", 2, "{tu es|t'es|tes|vous etes} {un|une|vraiment|trop|tellement|qu'un|qu'une|si|le|la|juste|gros|grosse|sale|pauvre}* FR_N"),
    ("insult", 2, "{tu es|t'es|vous etes} {un|une|vraiment|trop|tellement|qu'un|si|juste|gros|sale|pauvre}* FR_M END"),
    ("insult", 2, "espece {de|d'} {gros|sale|petit}? {FR_N|FR_M}"),
    ("insult", 1.5, "{sale|pauvre|gros|grosse} FR_N"),
    ("insult", 4, "espece {d'idiot|d'imbecile|d'ordure|d'abruti|d'encule}"),
    ("insult", 4, "{ferme|ta} {ta|gueule} {gueule|END|FR_N}"),
    ("insult", 4, "va te faire {foutre|enculer|voir}"),
    ("threat", 2, "{je|on} {vais|va} {te|vous} _1 FR_V"),
    ("threat", 4, "{va|allez} {crever|mourir}"),
    ("threat", 4, "{j'espere|espere} que tu {creves|meurs|vas|mourras} {crever|mourir|END}?"),
    ("hate", 1.5, "{arabes|juifs|noirs|immigres|migrants|musulmans|femmes|etrangers|refugies|gitans} sont {une|des|que|tous|de|la}* FR_D"),
    ("hate", 1.5, "{tous|toutes|ces} {les|des}? _2 sont {une|des|que|tous|de|la}* FR_D"),
    ("hate", 4, "{rentre|retourne|rentrez|retournez} {dans|chez} {ton|toi|votre|vous} {pays|END}?"),
    ("sexual", 4.5, "{envoie|envoies|montre} {moi|tes|des|photos|une}* {nudes|nue|nu|seins|nichons}"),
    ("sexual", 4.5, "{envoie-moi|montre-moi} {tes|des|photos|une}* {nudes|nue|nu|seins|nichons}"),
]
#: Words after which a clause is talk about words, and how many tokens this holds.
REPORTING = (
    "word words term phrase insult insults slur slurs called calls calling labelled labeled quote quoted quoting said says saying wrote writes filter filters flags flagged flag reported spelled meaning definition lyrics lyric title titled "
    "shouted yelled screamed heard joked translation translates line sentence"
).split()
REPORT_REACH = 4
NEGATING = "not never no isn't aren't wasn't don't dont doesn't didn't isnt arent without hardly nobody's won't wont can't cant wouldn't shouldn't nicht kein keine nunca jamais pas".split()
NEGATION_REACH = 2
#: A clause right before one of these speakers and verbs is reported.
SPEAKERS = "he she they someone somebody people man woman kid boy girl guy teacher boss mum mom dad brother sister it character narrator villain who".split()
SPEECH = "said says shouted yelled screamed wrote joked replied told growled whispered sang sings answered muttered".split()
AFTER_REACH = 4

_LEET = str.maketrans({"0": "o", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e", "£": "l", "!": "i", "|": "i", "+": "t", "(": "c"})
_SEPARATED = re.compile(r"(?<![^\s\"'“‘(*_])((?:[^\W_]([ .\-_*·/]{1,2}))(?:[^\W_]\2)+[^\W_])(?![^\W_])")
_INVISIBLE = re.compile(r"[​-‏⁠﻿­]")
_TOKEN = re.compile(r"[^\s\"“”«»,;:…()\[\]<>{}]+|[,;:…()]")
_EDGE = "\"'“”‘’«»([{<>)]}~_*.!?-"
_STRETCH = re.compile(r"(.)\1+")


def _split(body: str, at: str) -> list[str]:
    """`body` cut at `at` outside of braces."""
    parts, depth = [""], 0
    for c in body:
        depth += (c == "{") - (c == "}")
        if c == at and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return [p for p in parts if p]


class Grammar:
    """The union of the rules as one automaton without empty arcs, with start states and accepting rules."""

    def __init__(self, rules=RULES):
        self.arcs: list[dict[str, set[int]]] = []
        self.accepts: dict[int, list[int]] = {}
        self.starts: set[int] = set()
        self.rules = [(c, float(w)) for c, w, _ in rules]
        for number, (_, _, pattern) in enumerate(rules):
            start = self._state()
            self.starts.add(start)
            for f in self._sequence(pattern, {start}):
                self.accepts.setdefault(f, []).append(number)
        self.words = {s for arcs in self.arcs for s in arcs if s not in CLASSES and s not in ("_", "#", "END", "STOP")}

    def _state(self) -> int:
        self.arcs.append({})
        return len(self.arcs) - 1

    def _sequence(self, pattern: str, fronts: set[int]) -> set[int]:
        """The states reached from `fronts` by the items of `pattern`."""
        for part in _split(pattern, " "):
            if m := re.fullmatch(r"_(\d+)", part):
                reached = set(fronts)
                for _ in range(int(m[1])):
                    fronts = self._item("_", fronts)
                    reached |= fronts
                fronts = reached
                continue
            kind = part[-1] if part[-1] in "?*+" else ""
            body = part.removesuffix(kind) if kind else part
            end = self._item(body, fronts)
            if kind in ("*", "+"):
                again = self._item(body, end)
                for f in set(end):  # what follows the first leads to the same places again
                    for symbol, to in list(self.arcs[f].items()):
                        if to & again:
                            self.arcs[f][symbol] = (to - again) | end
            fronts = end | (fronts if kind in ("?", "*") else set())
        return fronts

    def _item(self, body: str, fronts: set[int]) -> set[int]:
        """The states reached by one item, a word, a class or alternatives in braces."""
        if body.startswith("{"):
            singles = [a for a in _split(body[1:-1], "|") if " " not in a and "{" not in a]
            longer = [a for a in _split(body[1:-1], "|") if a not in singles]
            end = self._linked(fronts, singles) if singles else set()
            for a in longer:
                end |= self._sequence(a, fronts)
            return end
        return self._linked(fronts, [body])

    def _linked(self, fronts: set[int], symbols: list[str]) -> set[int]:
        to = self._state()
        for f in fronts:
            for s in symbols:
                self.arcs[f].setdefault(s, set()).add(to)
        return {to}


def _flat(word: str) -> str:
    """Without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c)).replace("ß", "ss")


class Lexicon:
    """The lexical transducer: a token's possible symbols."""

    def __init__(self, grammar: Grammar):
        self.symbols: dict[str, set[str]] = {}
        for word in grammar.words:
            self.symbols.setdefault(word, set()).add(word)
        for name, (_, words) in CLASSES.items():
            for word in words.split():
                self.symbols.setdefault(word, set()).add(name)
        content = {w for n in ("N", "M", "A", "DEHUM", "KILL", "HURT", "DONE", "NUDE", "LEWD", "EXPEL", "BANISH", "PICS", "SEX") for w in CLASSES[n][1].split()} | {w for w in grammar.words if len(w) >= 4}
        for name, words in (("REPORT", REPORTING), ("NEG", NEGATING), ("SPEAKER", SPEAKERS), ("SPEECH", SPEECH), ("END", ENDING)):
            for word in words:
                self.symbols.setdefault(word, set()).add(name)
        self.short: dict[str, str] = {}
        for word in sorted(self.symbols, key=len):
            if len(word) >= 3:
                self.short.setdefault(_STRETCH.sub(r"\1", word), word)
        self.content = sorted(w for w in content if len(w) >= 3 and w.isalpha() and w not in ENDING)
        self.swapped = {(w[0], "".join(sorted(w))): w for w in self.content if len(w) >= 5}
        self.near: dict[str, list[str]] = {}  # words of seven letters or more, by themselves without one letter
        for w in self.content:
            for form in _shorter(w) if len(w) >= 7 else ():
                self.near.setdefault(form, []).append(w)
        self.every_mask = [(re.compile("".join(f"(?:{re.escape(c)}|[*#_])+" for c in _STRETCH.sub(r"\1", w))), w) for w in self.content]
        self.masked: dict[str, list] = {}
        for pattern, w in self.every_mask:
            self.masked.setdefault(w[0], []).append((pattern, w))
        self.of = lru_cache(200_000)(self._of)

    def disguised(self, token: str) -> str | None:
        flat = token.translate(_LEET)
        forms = {flat.replace("1", "i"), flat.replace("1", "l"), token}
        for form in sorted(forms):
            bare = re.sub(r"[.\-_/·]", "", form)
            if bare in self.symbols:
                return bare
            short = _STRETCH.sub(r"\1", bare)
            if len(short) >= 3 and short in self.short and (len(bare) >= 4):
                return self.short[short]
        if ("*" in token or "#" in token[1:]) and sum(c.isalpha() for c in token) * 2 >= len(token):
            for form in sorted(f for f in forms if f[0] != "#"):
                for pattern, word in self.masked.get(form[0], self.every_mask if form[0] in "*_" else ()):
                    if pattern.fullmatch(form):
                        return word
        if token.isalpha() and token.isascii() and len(token) >= 5:
            if word := self.swapped.get((token[0], "".join(sorted(token)))):
                return word
            if len(token) >= 6:
                near = {w for form in _shorter(token) for w in self.near.get(form, ())}
                for word in sorted(near):
                    if token[0] == word[0] and _one_edit(token, word):
                        return word
        return None

    def _of(self, token: str) -> frozenset[str]:
        """Symbols of a token in lower case; an account name or an unknown word has none of its own."""
        token = _flat(token.replace("’", "'"))
        bare = token.strip(_EDGE)
        for form in (bare, token.rstrip(".!?\"'”’"), token.strip(".!?\"'")):
            if not form or form.isdigit():
                continue
            found = form if form in self.symbols else self.disguised(form)
            if found:
                return frozenset(self.symbols[found] | (set() if "NEG" in self.symbols[found] else {"_"}))
        if re.fullmatch(r"@\w{2,}", bare.rstrip(",.:;")):
            return frozenset(["#", "_"])
        return frozenset(["_"] if any(c.isalnum() for c in bare) else [])


def _shorter(word: str) -> set[str]:
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}


def _one_edit(a: str, b: str) -> bool:
    """Whether one letter put in, taken out or replaced makes one word of the other."""
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def _tokens(text: str, lexicon: Lexicon) -> Iterator[str]:
    text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))

    def join(m: re.Match) -> str:
        joined = m[1].replace(m[2], "")
        low = joined.lower()
        if low[0] in "ai" and not lexicon.disguised(low) and lexicon.disguised(low[1:]):
            return f"{joined[0]} {joined[1:]}"
        return joined

    yield from _TOKEN.findall(_SEPARATED.sub(join, text))


#: State: partial clauses with their weights (the context's silence is part of a clause), how long reporting and negation hold, complete
#: clauses that may yet turn out to be reported with their age, and whether the last token was a speaker.
_START = (frozenset(), 0, 0, frozenset(), False)
_COMMA, _STOP = frozenset(["END"]), frozenset(["END", "STOP"])
#: States kept before the automaton is built anew.
MOST_NODES = 100_000


class Node:
    """A state of the deterministic automaton with the transitions built so far; idle if no clause has begun or waits."""

    __slots__ = ("state", "after", "idle")

    def __init__(self, state: tuple):
        self.state, self.after = state, {}
        self.idle = not state[0] and not state[3]


class Scorer:
    """The composition of lexicon, grammar and context, as a lazily built deterministic automaton."""

    def __init__(self, rules=RULES):
        self.grammar = Grammar(rules)
        self.lexicon = Lexicon(self.grammar)
        self.weights = {name: weight for name, (weight, _) in CLASSES.items()}
        self.nodes: dict[tuple, Node] = {}
        self.start = self._node(_START)

    def _followed(self, items, symbols: frozenset[str]) -> tuple[dict, dict]:
        """Partial clauses after a token with the heaviest weight of each, and complete ones as category: weight."""
        reached: dict[tuple, float] = {}
        found: dict[str, float] = {}
        for (number, muted), weight in items:
            for symbol in symbols:
                for to in self.grammar.arcs[number].get(symbol, ()):
                    w = weight + self.weights.get(symbol, 0.0)
                    reached[to, muted] = max(w, reached.get((to, muted), -9.0))
        for (to, muted), w in reached.items():
            for rule in () if muted else self.grammar.accepts.get(to, ()):
                category, base = self.grammar.rules[rule]
                found[category] = max(base + w, found.get(category, 0.0))
        return reached, found

    def _step(self, state: tuple, symbols: frozenset[str]) -> tuple:
        """Next state and the clauses that count for good. A sign (_COMMA, _STOP) is no word: clauses run on over it."""
        items, report, negation, waiting, speaker = state
        if symbols == _COMMA or symbols == _STOP:
            reached, found = self._followed(items, symbols)
            merged = dict(items)
            for key, w in reached.items():
                merged[key] = max(w, merged.get(key, -9.0))
            kept = waiting | {(c, w, 0) for c, w in found.items()}
            return (frozenset(merged.items()), report, negation, kept, speaker), ()
        quiet = report > 0 or negation > 0
        reached, found = self._followed([*items, *(((s, quiet), 0.0) for s in self.grammar.starts)], symbols)
        if speaker and "SPEECH" in symbols:
            waiting = frozenset()  # "..., he said"
        aged = {(c, w, age + 1) for c, w, age in waiting}
        counted = tuple((c, w) for c, w, age in aged if age > AFTER_REACH)
        kept = frozenset(x for x in aged if x[2] <= AFTER_REACH) | {(c, w, 0) for c, w in found.items()}
        report = REPORT_REACH if "REPORT" in symbols else max(0, report - 1)
        negation = NEGATION_REACH if "NEG" in symbols else max(0, negation - 1)
        return (frozenset(reached.items()), report, negation, kept, "SPEAKER" in symbols), counted

    def _node(self, state: tuple) -> Node:
        node = self.nodes.get(state)
        if node is None:
            node = self.nodes[state] = Node(state)
        return node

    def _next(self, node: Node, symbols: frozenset[str]) -> tuple[Node, tuple]:
        after = node.after.get(symbols)
        if after is None:
            state, counted = self._step(node.state, symbols)
            after = node.after[symbols] = (self._node(state), counted)
        return after

    def score(self, text: str | None) -> tuple[float, list[str]]:
        """The score of a text and its categories in order of name."""
        if not text:
            return 0.0, []
        if len(self.nodes) > MOST_NODES:
            self.nodes.clear()
            self.start = self._node(_START)
        best: dict[str, float] = {}
        node = start = self.start
        for token in _tokens(text, self.lexicon):
            if token in ",;:()":
                if not node.idle:
                    node = self._next(node, _COMMA)[0]  # clauses run on over commas
                continue
            if not node.idle and token[0].isupper() and token != "I" and node is not start:
                node = self._next(node, _STOP)[0]  # perhaps a new sentence without a sign before it
            if token != "…":
                symbols = self.lexicon.of(token.lower())
                if symbols:
                    node, counted = self._next(node, symbols)
                    for category, weight in counted:
                        best[category] = max(best.get(category, 0.0), weight)
            if token[-1] in ".!?…" and (len(token) < 2 or not token[:-1].lower().endswith(("st", "mr", "dr"))):
                # what waits may be reported in the next sentence
                node = start = self.start if node.idle else self._node((*_START[:3], self._next(node, _STOP)[0].state[3], False))
        for category, weight, _ in self._next(node, _STOP)[0].state[3]:
            best[category] = max(best.get(category, 0.0), weight)
        return float(sum(best.values())), sorted(c for c in best if best[c] > 0)


_scorer: list[Scorer] = []


def score_column(text: Column | str) -> Column:
    """A struct column (score, categories) of a text column."""

    @F.arrow_udf("score double, categories array<string>")
    def run(texts: pa.Array) -> pa.Array:
        if not _scorer:
            _scorer.append(Scorer())
        rows = [_scorer[0].score(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([s for s, _ in rows], pa.float64()), pa.array([c for _, c in rows], pa.list_(pa.string()))], names=["score", "categories"])

    return run(text)


def scores(posts: DataFrame, rule_scores: DataFrame, id_col: str = "pos", threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, source, score, categories, flagged, rule_total) of every post; `rule_total` is the largest total that the
    rules gave it, null without one. Sources are trimmed and in lower case."""
    rows = posts.select(F.col(id_col), F.nullif(F.lower(F.trim("source")), F.lit("")).alias("source"), score_column(F.col("text")).alias("s"))
    rules = rule_scores.groupBy(F.col(id_col)).agg(F.max("total").alias("rule_total"))
    return rows.join(rules, id_col, "left").select(id_col, "source", F.col("s.score").alias("score"), F.col("s.categories").alias("categories"), (F.col("s.score") >= threshold).alias("flagged"), "rule_total")


def rates(scored: DataFrame) -> DataFrame:
    """(source, n_posts, n_flagged, rate, mean_score, n_rule_flagged) per source, null sources as one group."""
    n = F.count(F.lit(1))
    flagged = F.count_if("flagged")
    return scored.groupBy("source").agg(n.alias("n_posts"), flagged.alias("n_flagged"), (flagged / n).alias("rate"), F.avg("score").alias("mean_score"), F.count_if(F.col("rule_total") > 0).alias("n_rule_flagged"))
