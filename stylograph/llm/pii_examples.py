"""The small labelled table that the recognizer of personal information is trained from.

Rows are made by rule from a seed: phrases with alternatives and slots, filled with invented values in many written forms,
between sentences of a small grammar that hold numbers, capitals and accounts but no personal information. Phrases and words
were written for this table, for no corpus; names are common ones of several languages and made-up ones.

In a phrase, (a|b|) stands for one of its alternatives and {X} for a slot.
"""

from __future__ import annotations

import random
import re

from stylograph.functions.lexicons import FUNCTION_WORDS, STOPWORDS

GIVEN = (
    "Anna Peter Maria Jonas Clara Tomas Nadia Felix Irene Oskar Lucia Emil Kwame Yuki Omar Leila Chen Fatima Sven Ingrid Pablo Carmen Jean Amelie Giulia Marco Olga Dmitri Aisha Grace Rose Will Mark Joy "
    "James Linda Robert Susan Michael Karen David Nancy Daniel Emily Laura Kevin Brian Helen Andrew Ruth Samuel Julia Victor Diana Hassan Zara Mateo Sofia Hugo Elise Noah Mia Ahmed Mei Ravi Anjali Bjorn Freya Kofi Amara Ivan Petra"
).split()
FAMILY = (
    "Larsson Petrov Whitby Ferrand Oduya Marchetti Brandt Sokol Iversen Navarro Keating Smith Jones Brown Wilson Taylor Clark Lewis Walker Hall Young King Wright Hill Green Baker Nelson Carter Mitchell Turner Parker Collins Stewart "
    "Morris Murphy Cook Rogers Reed Bailey Cooper Ward Cox Gray Watson Brooks Kelly Price Bennett Wood Ross Henderson Coleman Jenkins Perry Powell Long Hughes Müller Schmidt Weber Dubois Moreau Rossi Ferrari Tanaka Suzuki Kim Nguyen Patel "
    "Sharma Khan Ali Okafor Mensah Novak Kowalski Jansen Silva Santos Garcia Lopez Haddad Cohen Ivanova Svensson"
).split()
STARTS, MIDDLES = "Ba Bri Da Dor El Fa Fen Ga Hal Is Jo Kel Ler Lin Ma Mer Nor Ori Per Qua Rel Sa Syl Ta Tor Ul Ves Wil Yan Zel Cor Dun Grim Kest Mun Ot Rus Sten Thar Wex Ash Brack Pell Lor".split(), "a e i o ri la na te vi ro mi".split()
GIVEN_ENDS = "na lia an iel eth ra sel vin isa don mir ette lo wen us ius ella etta bert fred rick ward win olin ine ita elda ario ermo ene aham iah ya oline anda".split()
FAMILY_ENDS = (
    "son berg man well ford ton combe wick ley mere holt garth shaw by field strand ski ova ez quist low dale worth stein berger mann sson sen escu enko ovic oglu ian yan ante anza illa elli ini etti ault eau wski czyk nathan swamy moto mura ham more ock bury lock "
    "thwaite don cott steen athy aker ington croft bridge wood house ander"
).split()
NOUNS = (
    "garden kettle engine harbour market ticket window blanket poster river bridge saddle hammer candle paper archive bakery cousin editor nurse teacher brake drummer notebook shelf violin railway puzzle meadow recipe shovel carpet island "
    "tunnel museum printer jacket parcel kitchen meeting report bus train dog cat coffee weather street house phone letter table song film book school office team weekend holiday lunch dinner bike car plant cake lamp chair"
).split()
ADJECTIVES = "quiet gentle rusty modern ancient bitter clever warm steep narrow golden plain brittle humid simple noisy fresh tidy vague common late early cheap broken blue green old new long short strange happy lazy busy empty".split()
VERBS = "paint borrow repair sketch measure collect follow visit water carry polish share unpack deliver find lose need want see like keep bring sell buy clean watch read forget miss open close call".split()
PLACES = "Springfield Riverside Oslo Lisbon Nairobi Kyoto Leeds Porto Bergen Quito Dublin Vienna Austin Geneva Lagos Hanoi Cork Turin".split()
TITLED = (
    "New York Times|Green Valley School|Red Cross|Black Friday|Harry Potter|Star Wars|Lake District|North Sea|Grand Hotel|City Library|Old Town Hall|Blue Whale|Summer Reading Club|Monday Morning|Happy Birthday|Good Morning|Machine Learning|"
    "Data Science|United Nations|Silver Lining|West Wing|Central Park|Christmas Eve|First Aid|Golden Gate|High Street|Main Station|Open Source|Quick Start|Project Manager|Senior Engineer|Part Two|Dear Sir|Yours Truly|Rose Garden|Grace Period|Mark Down|Joy Ride|Will Power"
).split("|")
WEBS, TLDS = "hub desk net via pad log bit way kit mail box corp post lane works".split(), "example invalid test com org net de fr io edu gov co.uk com.au example.com example.org co.jp".split()
#: Words of the language's frame; with words made up by `Maker.unknown` they make sentences of no meaning.
FRAME = sorted({*FUNCTION_WORDS, *STOPWORDS} - set("s t d ll m re ve don didn doesn isn aren wasn weren won".split())) + (
    "every everyone everybody somebody someone nobody nothing something although because since until while whether without against between during behind under near toward turns spent small honestly maybe perhaps instead together upstairs indoors "
    "somehow mostly nearly often almost finally suddenly apparently eventually anyway tonight today yesterday tomorrow morning midnight noon weekend summer winter spring autumn monday tuesday wednesday thursday friday saturday sunday january "
    "march april june july august september october november december one two three four five six seven eight nine ten several few another each both don't can't isn't won't it's i'd you'd they're that's let's"
).split()
#: The frame of other languages.
FOREIGN = (
    "der die das und ist ein eine nicht mit für auf von zu im bei ohne wer wird auch ich mein war noch schon so heute gestern aber wenn wie el la los las un una y es de del con sin que se no su más pero hoy ayer si cada me cerca porque estaba sigue otra vez tiene parece nadie quiso "
    "le les une et est des du sous avec pour chaque je mon ou aussi était reste près on a au ne personne voulait hier il elle dans qui mais"
).split()
STREETS = "Maple Quarry Orchard Copper Ferry Lantern Birch Alder Cobbler Mallow Harrow Juniper Sexton Wren Gorse Tansy Thistle Fuller Church Mill Station Queen King Park Elm Oak Cedar Hill Victoria River Garden Market Spring Washington Bridge".split()
WAYS = "Street St Road Rd Avenue Ave Lane Ln Close Court Ct Drive Dr Terrace Way Boulevard Blvd Square Place Crescent Row Gardens Grove".split()

FILLERS = [
    "the {n} (is|was|looks|stays) {a}", "(I|we|they) {v} the {a} {n}( again| today| at home|)", "(why|when|how) (do|did) (you|we|they) {v} (a|the) {n}", "{n} and {n}, {a} (as ever|enough|again)", "(never|always|just) {v} a {a} {n}", "there is a {n} (in|near|behind) the {a} {n}",
    "(it|this) took {d2} (days|minutes|weeks) to {v} the {n}", "my {n} needs {d1} more {n}s", "(greetings|news|back) from {p}", "{p} is {a} in (May|June|October|winter)", "{w} (has|made|sold) the {a} {n}", "(I|we) read the {t} (today|on Sunday|)", "{t} (is|was) {a}", "(thanks|hello) @{h} (and @{h}|) for the {n}",
    "#{n} #{a}{n} @{h}", "@{h} {v} the {n} https://{l}.test/{l}{d2}", "RT @{h}: the {n} is {a}", "(see|via) www.{l}.com/{l}/{d4}", "der {n} von {w} ist {a}, aber die {n} (nicht|auch)", "le {n} de {w} est {a} et la {n} aussi", "el {n} de {p} parece {a} otra vez", "{g} (is|was) {a} (today|again|)", "(I|we) met {g} (by|at) the {n}", "{g}'s {n} was {a}",
    "(Dr|Mrs|Mr). {f} (likes|knows) the {n}", "(I'd|you'd) rather {v} {d1} {n}s than {v} a {n}", "if you {v} the {n} it (will|would) feel {a}", "(rose|mark|grace|will|joy) {n}s in the {a} {n}", "{w} {n} and {w} {n} are all you need", "(Chapter|Part|Level|Room) {d1}: The {N} of {P}", "{A} {N}", "The {A} {N}(s|) of {w}", "small {n}, {a} {n}, no {n}",
    *["{BABBLE}"] * 14, *["{BABBLE} {w}"] * 3, "{BABBLE} with (my|two|some|a|the|our) {u}(s|)", "{BABBLE} @{l}( #{l}{d2}|) @{l}", "@{l} @{l} #{l} #{l}{d2} @{l}( #{n}| @{h}|)", "#{l} #{n} #{l}", "{BABBLE} {w} {BABBLE}", "the {u} at the {u} {u}", "{W} {W} {W}", "{BABBLE} {W} {BABBLE}", "{BABBLE} (Upper|Lower|New|Old|North|South|East|West|Great|Little|Mount|Port|Lake) {w}( {BABBLE}|)", "(greetings|back|home|news) from (Upper|Lower|New|North|South|East|West) {w} and the {u} {u}", "{A} {N} (Fans|Crew|Folks|People|Team|Club)", "(hello|gm|hi|dear) {N} (fans|crew|folks|people|team)",
    *["{FOREIGN}"] * 5, "{FOREIGN} (de|von|di) {w}", "{FOREIGN} {w} {FOREIGN}", *["P.S. {BABBLE}", "P.S. {w} {BABBLE}", "P.S. {W} {BABBLE}"] * 2, "(Professor|Doctor|Captain|Aunt|Uncle|King|Saint) ({f}|{g}) {BABBLE}", "{W} {W}", "{SPACED} {BABBLE}", "{BABBLE} {SPACED} {u}", "{JUNK}", "{J}. {d2} {n}s\n{J}. {v} the {n}\n{J}. {w} {n}", "https://t.{l}.test/{CODE} {BABBLE}", "{BABBLE} https://{l}.org/{CODE}", "(a|the|all|those) {u}-{u} {BABBLE}", "(all|those|never trust a) {w}s {BABBLE}",
    "{n} {a}. {v} it", "(the|a) {n} {v}s itself", "(honestly|maybe|well), {a} is (better|worse) than {a}", "{w} {w} and the {n}", "by {p} {N}", "(Monday|Tuesday|Friday) {N} in {p}",
]
NUMBERS = [
    "(order|invoice|ticket) (no. |#|){d3}-{d6} (shipped|is open|)", "(build|version) {d1}.{d2}.{d4}", "10.{d3}.{d3}.{d3} (answers|is down)", "on 20{d2}-1{d1}-{d2} we {v} it", "the score was {d2}-{d2}", "(raised|cost|paid) {d1},{d3},{d3} (coins|euro)", "it is {d2}.{d2} at {d2}:{d2}", "{w} {d2}.{d2} {d4} {d2}%", "{w}\t{d5}\t{d2}%\t{n}",
    "{w}: {d4}", "| {w} | {d2}.{d2} | {d4} |", "{d4} {d3} {d3} {d4} {d3}", "https://{l}.test/{l}{d2}", "room {d3}, bus {d2}", "0x{d4} 0x{d4}", "{d2} {n}s, {d1} {a} {n}s", "page {d3} of {d3}", "ISBN 978-{d1}-{d3}-{d5}-{d1}", "{d1}/{d1} {a} {n}", "{w},{d2}.{d2},{n},{d4}", "track no. {d3} {d3} {d2}", "{d2}.{d2}.20{d2} (was|is) {a}", "{d2} {n} (Street|Road) (was|looks) {a}",
    "{w};{d2}%;{d2}.{d2};{u}\n{w};{d2}.{d2};{d3};{d2}%\n{w};{d5};{u};{d2}.{d2}", "{w}\t{d2}.{d2}\t{u}\t{d2}%\n{w}\t{d4}\t{d2}%\t{d3}", "{u}: {d2}, {u}: {d3}, {u}: {d1}", "{d2}.{d2},{d3}%,{u},{w}\n{d5},{d2}.{d2},{d2},{w}", "| {w} | {u} | {d2}.{d2} |\n| {w} | {d4} | {d2}% |", "{BABBLE} {d2} {BABBLE}", "{BABBLE} {d4} {u}s", "{d1} {u}s, {u} {w}, {d2} {u}s",
    *["{SERIES}"] * 2, "{BABBLE} {SERIES}", *["(see|host|server|ping|at) {d2}.{d3}.{d2}.{d2} {BABBLE}", "{d3}.{d2}.{d1}.{d3}"] * 2, "{w}   {d2}.{d2}        {d2}.{d2}        {d2}%        {d2}\n{w}      {d2}%       {d3}      {u}     {d2}.{d2}", "{w}\t{d4}\t{d2}.{d2}\t{d2}\t{d2}.{d2}\n{w}\t{u}\t{d2}%\t{d3}\t{d5}", "room {d3} {BABBLE}", "(order|ref|sku|code) {L}{d4}{L}{d2}", "{w} {d4}-{d4} {BABBLE}",
    "(born|since|in) 19{d2}", "{d4}{d4}{d4}{d4}{d4}", "lot {d5}, row {d2}", "{a} {n}: {d4}\n{a} {n}: {d4}\n{n}: 0{d3}", "  {w}   {d2}.{d2}   {n}   {d4}", "{w} {d2}\n{w} {d3}\n{w} {d2}", "model {L}{d3}-{d2}", "{d3}{L}{d4} failed", "(top|best) {d2} {n}s of 20{d2}", "{d2}° and {d2} km, {d3} m", "{d1}. {a} {n}\n{d1}. {v} the {n}",
]
NAMES = [
    "(lunch|dinner|coffee|a walk|a call) with {NAME} (was|is) {a}", "(I|we) (met|saw|visited|asked|thanked|paid|trust) {NAME}( at the {n}| yesterday| again|)", "{NAME} (wrote|said|sent|sold|has|owns|brought|knows|fixed|wants) (the|this|a|me a) {n}", "(ask|tell|call|email|thank|see) {NAME}( about the {n}| first|)", "(my|our|her|his) (boss|friend|doctor|neighbour|uncle|teacher|agent|plumber) {NAME}( is {a}| never {v}s|)",
    "(signed|yours|best|regards|cheers|love|sincerely), {NAME}", "{NAME}'s {n} (was|is) {a}", "(thanks|thank you) to (Dr. |Mr |Mrs. |Prof. |){NAME}( for the {n}|)", "(by|photo by|photo:|text:|from|cc|via|feat.|—|with) {NAME}", "(Mr|Mrs|Ms|Dr|Prof|Mr.|Mrs.|Dr.) {NAME} (called|agreed|is out)", "{NAME} and {NAME} (won|left|agreed)", "(happy birthday|welcome|goodbye|congrats), {NAME}", "{NAME}", "{NAME} (is|was) {a}", "the late {NAME} had a {n}",
    "{BABBLE} {NAME} {BABBLE}", "{BABBLE} {NAME}", "{NAME} {BABBLE}", "{BABBLE}, {NAME}, {BABBLE}", "{BABBLE} {NAME}'s {u}", "(my|our|her) {u} {NAME} {BABBLE}", "{BABBLE} (Dr.|Mr|Mrs|Ms|Prof.) {NAME} {BABBLE}",
    "(contact|name|attn|author|tenant|patient)(:| is|) {NAME}", "(is|was) {NAME} {a}", "between {NAME} and the {n}",     "(I|we|they) (owe|gave|sent|lent|miss|know|thanked|invited) {NAME} {BABBLE}", "(hi|hello|hey), (this is|it's|I'm|I am|my name is) {NAME}( {BABBLE}|)", "(Captain|Professor|Judge|Aunt|Uncle|Sister|Father|Coach|President|Queen) {NAME} {BABBLE}", "(tickets|flowers|room|parcel|table) for {NAME}( {BABBLE}|)", "(minutes|drawn|taken|written|edited) (by|by:) {NAME}",
    "(the|a) {u} (of|for|by|about|to|from|with) {NAME} {BABBLE}", "{BABBLE} and {NAME}", "our {u}, {NAME}, {BABBLE}", "{NAME}, {NAME} and {g}", "the {n} of {NAME}", "(heard|read|got) (it|that) from {NAME}", "{NAME}: the {n} is {a}", "(owes|gave|lent) {NAME} a {n}", "{NAME} (owes|gave|lent|owed) me a {n}",
]
EMAILS = [
    "(write|mail|send it|reply|forward it|post) (to|at|) {E}", "(reach|contact|find|ask|message) (me|us|them) (at|on|via|under) {E}( please| today|)", "(my|our|the|her) (address|e-mail|email|mail|contact) (is|:|=) {E}", "(e-mail|email|mail|contact|to|from|cc|bcc)(:|: | ){E}", "mailto:{E}", "\\({E}\\)", "{E}", "(just|I) sent (it|the {n}) to {E}( and got no reply|)", "(use|try) {E} (instead|for the {n})", "{E}, {E}", "(or|and) {E}", "<{E}>", "(write|mail) to <{E}>", "questions? {E}",
    "{E} (and|or|,) {E}( {BABBLE}|)", "(cc|to|from): {E} and {E}", "{BABBLE} {E} {BABBLE}", "{BABBLE} {E}", "{BABBLE} \\({E}\\)", "{E} {BABBLE}",
    "{E} (bounced|is full|works|is mine)", "[{E}]", "{E} / {E}", "\"{E}\"",
]
PHONES = [
    "(call|ring|text|phone|dial|try|reach|message|whatsapp|signal|sms) (me|us|him|her|them|the {n}|) (on |at |under |: |){T}( after {d2}:{d2}| now| please|)", "(my|our|the|her) (new |)(number|cell|mobile|landline|phone|fax) (is|:|=) {T}( the {n} is {a}|)", "(tel|phone|mobile|cell|fax|ph|call|m|t)(:|.|) {T}", "\\((phone|tel|call|fax) {T}\\)", "{T}", "(or|and|then) {T}( or just {v} it|)", "{T} (is|was) (busy|mine|wrong|off)",
    "(call|ring|text|phone|dial|try|WhatsApp|message) {T}( {BABBLE}|)", "(call|ring|text|phone) (me|us) (on |at |){T} {BABBLE}", "{BABBLE} {T} {BABBLE}", "{BABBLE} {T}", "{T} {BABBLE}", "(my|our|the) {u} (is|:) {T}",
    *["(my|our|his|her|the) (new |old |)number (is|was|:) {T}( {BABBLE}|)"] * 3, "(give me a shout|give us a buzz|ping me|hit me up|reach out), {T}", "(she|he|it) is (on|at|under) {T} {BABBLE}", "{E}\n(tel|phone|mobile): {T}( {BABBLE}|)", "(or|and) {T}\n{BABBLE}", "the number's {T}, {BABBLE}",
    "(phone|tel) {T}, fax {T}", "{T} / {T}", "(dial|call) {T} (for|about) the {n}", "(no answer|voicemail) (at|on) {T}", "the {n} \\({T}\\)", "(WhatsApp|Signal|Telegram) {T}( if you {v} it|)",
]
IDS = [
    "(SSN|ssn|social security|social|soc sec|social security number)(:| no.| number| is|) {S}", "(SSN|ssn)( without dashes| no dashes|) {9}", "my (SSN|ssn|social) (is |){9}", "(NI|NINO|nino|national insurance|NI no.|NI number)(:| number| is|) {Q}", "(passport|passport no.|passport number|travelling on passport)(:| is|) {X}",
    "(licence|license|driving licence|driver's license|driver license|DL)(:| no.| number| is|) {L}", "(DNI|NIE|NIF|mi DNI es|dni)(:| no.|) {D}", "(ID|ID card|identity card|id no.|id number|ID no.|national id|Ausweis|Ausweisnummer|carte d'identité)(:| number| is| no.| no. is|) {B}", "(IBAN|iban|account|Konto|bank account)(:| is| no.|) {Z}",
    "(tax id|TIN|tax number|Steuer-ID|CPF|taxpayer id|personal tax id)(:| is|) {Y}", "my (id|ID) (number |no. |card |)is {I}", "{S}( on the form| in the file|)", "{Q}( on the form| in the file|)", "{Z}", "{X} (expired|is my passport)", "they (asked for|wanted|need) my (SSN|id|ID|passport|licence), it's {I}", "(the|a) (form|bank|clerk|office) (asks for|wants) {I}", "{I}, don't share", "{BABBLE} (SSN|passport|licence|DNI|ID|NI no.|IBAN) {I} {BABBLE}", "(my|the|her) (id|SSN|passport|DNI|licence) (is|:|no.) {I} {BABBLE}", "{L}", "{B}", "{D}",
]
PLACED = [
    "(I|we|they) (live|lived|stay|moved|work) (at|to|near) {H}( now| since {d4}|)", "(party|dinner|meeting|drinks) at {H}( from eight| tonight|)", "(drop|leave|send|bring|post|ship|deliver) (it|this|the {n}) (off |)(at|to) {H}( please|, side door|)", "(meet|wait|park) (me |us |)(outside|at|near|by) {H}", "(my|our|the) (address|place|flat|home|office) (is|:|=) {H}", "(address|deliver to|ship to|home|post to)(:|) {H}",
    "{BABBLE} {H} {BABBLE}", "{BABBLE} (at|to|outside|near|from) {H}", "(live|party|meet|moved|deliver) (at|to|outside) {H} {BABBLE}", "{H} {BABBLE}", "{H} (is|was|has|lies) {BABBLE}",
    "parcel for {H}", "come to {H}( tonight| at {d2}|)", "{H}", "{H}, {p}", "{H} (is|was) {a}", "(found|lost) a {n} at {H}", "from {H} to {H}", "(return|write) to {H}", "the {n} at {H}", "ring the bell at {H}",
]
#: The same phrases about something else.
OTHERS = {"NAME": "(my|the|a|some|two|our|every|his|that) ({a} |){u}(s|)|{g}|{w}|(me|you|it|them)|{p}|the {w} {u}|{f}|{t}", "T": "{d2}|{d3} {u}s|noon|the {u}|{d2}:{d2}|@{h}|{d4}", "E": "the {u}|@{h}|{p}|www.{l}.com|https://{l}.test/{l}", "H": "the {u}|{p}|{w}|(my|our) {u}|the {a} {u} {u}|{d2} {u}s|noon"}
MIXED = ["(Contact|contact|ask|reach) {NAME} \\({E}\\) or {T}", "(name|tenant): {NAME}\n(mail|email): {E}\n(phone|tel): {T}", "— {NAME}, {E}, {T}", "{NAME} / {E} / {T}", "{NAME} <{E}>", "{NAME}, {H}", "{NAME} {T}", "{NAME}\n{H}\n{T}", "{E} or {T}", "{NAME} \\({T}\\)", "{NAME}; {E}; {I}"]
GROUPS = [(FILLERS, 8.0), (NUMBERS, 2.4), (NAMES, 3.0), (EMAILS, 1.4), (PHONES, 1.9), (IDS, 2.0), (PLACED, 1.8), (MIXED, 1.2)]
#: Share of phrases about a person, address or number that are about something else instead.
OTHERWISE = 0.3
KIND_OF = {"NAME": "name", "E": "email", "T": "phone", "H": "address", **dict.fromkeys(["S", "9", "Q", "X", "L", "D", "B", "Z", "Y", "I"], "id_number")}
_CHOICE = re.compile(r"(?<!\\)\(([^()]*)(?<!\\)\)")


class Maker:
    """Makes labelled texts: (text, [(start, end, kind)])."""

    def __init__(self, given: list[str], family: list[str], seed: int = 5):
        self.r = random.Random(seed)
        self.given, self.family = given, family

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def letter(self) -> str:
        return self.r.choice("ABCDEFGHJKLMNPRSTWXYZ")

    def brand(self) -> str:
        return self.r.choice(STARTS) + self.r.choice(["", *MIDDLES]) + self.r.choice(WEBS)

    def name(self) -> str:
        r = self.r
        g, f = r.choice(self.given), r.choice(self.family)
        letter = self.letter()
        forms = [f"{g} {f}"] * 10 + [f"{f}, {g}"] * 2 + [f"{letter}. {f}"] * 2 + [f"{g} {letter}. {f}"] * 2 + [f"{g} {r.choice(['van', 'de', 'von', 'da', 'di', 'van der', 'de la', 'bin'])} {f}", f"{g} al-{f}", f"{g} {r.choice(['Ó', 'O', 'Mc', 'Mac', 'Ní'])} {f}", f"{g} O'{f}", f"{g} Mc{f}"]
        forms += [f"{g} {f}-{r.choice(self.family)}"] * 2 + [f"{g}-{r.choice(self.given)} {f}", f"{g} {r.choice(self.given)} {f}", f"{letter}.{self.letter()}. {f}", f"{g} {f} {r.choice(self.family)}"]
        text = r.choice(forms)
        return r.choices([text, text.upper(), text.lower()], [10, 1, 0.8])[0]

    def email(self) -> str:
        r = self.r
        g, f = (_plain(r.choice(x)) for x in (self.given, self.family))
        word = r.choice(NOUNS)
        local = r.choice([f"{g}.{f}", f"{g}_{f}{self.digits(2)}", f"{g}-{self.digits(4)}", f"{f}+{word}", f"{g}{f}", f"{g[0]}{f}", f"{r.choice(ADJECTIVES)}.{word}{self.digits(3)}", f, f"{g}.{f}+{word}", f"{g}{self.digits(2)}", f"{g[0]}.{f}", g, g, f"{g}{r.choice(NOUNS)}", f"{word}-{r.choice(NOUNS)}", f"{r.choice(['no', 'do-not', 'team', 'help', 'e'])}-{r.choice(['reply', word])}", "info", "office", f"{word}{self.digits(1)}", f"{g}.{r.choice('abcdel')}.{f}"])
        host = [*([r.choice(["mail", "inbox", "corp", "post", "staff", "lists"])] if r.random() < 0.4 else []), self.brand().lower() + r.choice(["", "", "", f"-{r.choice(WEBS)}"]), *r.choice(TLDS).split(".")]
        at, dot = "@", "."
        if r.random() < 0.28:
            at = r.choice(["[at]", " [at] ", " (at) ", " at ", " AT ", " @ ", "(at)", "{at}"])
            dot = r.choice([".", "[dot]", " dot ", " DOT ", " (dot) ", " . ", "."])
        text = local + at + dot.join(host)
        return text.upper() if r.random() < 0.08 else text

    def phone(self) -> str:
        r, d = self.r, self.digits
        s = r.choice([" ", "-", ".", "", "‑", "/"])
        t = r.choice([".", "-", " "])
        forms = [
            lambda: f"+44{s}7{d(3)}{s}{d(3)}{s}{d(3)}", lambda: f"0044{s}7{d(3)}{s}{d(3)}{s}{d(3)}", lambda: f"07{d(3)}{r.choice([' ', ''])}{d(6)}", lambda: f"+44 (0){d(2)} {d(4)} {d(4)}", lambda: f"02{d(1)} {d(4)} {d(4)}", lambda: f"+49 {d(2)} {d(5)}{r.choice(['', ' '])}{d(3)}", lambda: f"0{d(2)} {d(5)} {d(3)}",
            lambda: f"0{d(3)}/{d(7)}", lambda: f"(0{d(2)}) {d(r.choice([6, 7, 8]))}", lambda: f"(0{d(3)}) {d(3)} {d(r.choice([3, 4]))}", lambda: f"0{d(1)}-{d(8)}", lambda: f"+33{r.choice(['.', ' '])}{d(1)}{t}{d(2)}{t}{d(2)}{t}{d(2)}{t}{d(2)}", lambda: f"0{d(1)}{t}{d(2)}{t}{d(2)}{t}{d(2)}{t}{d(2)}", lambda: f"({d(3)}) {d(3)}{t}{d(4)}", lambda: f"{d(3)}{t}{d(3)}{t}{d(4)}", lambda: f"1{t}{d(3)}{t}{d(3)}{t}{d(4)}", lambda: f"+1{s}{d(3)}{s}{d(3)}{s}{d(4)}", lambda: f"+1 ({d(3)}) {d(3)}-{d(4)}",
            lambda: f"+1{d(10)}", lambda: f"+{r.choice(['49', '44', '33', '34', '39', '91', '61'])}{d(r.choice([9, 10, 11]))}", lambda: d(10), lambda: f"07{d(3)} {d(6)}", lambda: f"+34 {d(3)} {d(2)} {d(2)} {d(2)}", lambda: f"+34 {d(3)} {d(3)} {d(3)}", lambda: f"0{d(10)}", lambda: f"+{r.choice(['91', '81', '234', '61', '27', '353', '351', '48', '7'])}{s}{d(r.choice([2, 3]))}{s}{d(3)}{s}{d(4)}", lambda: f"+39 0{d(1)} {d(8)}", lambda: f"{d(2)} {d(2)} {d(2)} {d(2)} {d(2)}",
        ]
        text = r.choice(forms)()
        return text + (f"{r.choice([' ', ' ', ', '])}{r.choice(['ext', 'ext.', 'x', 'extension'])}{r.choice([' ', ' ', ''])}{d(r.choice([2, 3, 3, 4]))}" if r.random() < 0.17 else "")

    def identity(self, slot: str) -> str:
        r, d, a = self.r, self.digits, self.letter
        s = r.choice(["-", "-", " "])
        country = r.choice(["DE", "FR", "GB", "ES", "NL", "IT"])
        forms = {
            "S": lambda: r.choice([f"{d(3)}{s}{d(2)}{s}{d(4)}"] * 3 + [d(9)]), "9": lambda: d(9), "Q": lambda: r.choice([f"QQ {d(2)} {d(2)} {d(2)} {a()}", f"QQ{d(6)}{a()}", f"{a()}{a()}{d(6)}{a()}", f"{a()}{a()} {d(2)} {d(2)} {d(2)} {a()}"]), "X": lambda: r.choice([f"{a()}{d(8)}", d(9), f"{a()}{a()}{d(7)}", f"{a()}{d(7)}"]),
            "L": lambda: r.choice([f"{a()}{d(3)}-{d(4)}-{d(4)}", f"{a()}{d(7)}", f"{a()}{d(8)}", f"{a()}{a()}{a()}{a()}{a()}{d(6)}{a()}{a()}{d(1)}{a()}{a()}"]), "D": lambda: r.choice([f"{d(8)}-{a()}", f"{d(8)}{a()}", f"X{d(7)}{a()}"]), "B": lambda: r.choice([f"{d(2)}.{d(2)}.{d(2)}-{d(3)}.{d(2)}", d(9), f"{d(2)}.{d(2)}.{d(2)}-{d(3)}.{d(2)}", f"{a()}{d(8)}", f"{d(4)} {d(4)} {d(4)}"]),
            "Z": lambda: r.choice([f"{country}{d(2)} " + " ".join(d(4) for _ in range(r.choice([4, 5]))) + r.choice(["", f" {d(2)}"]), f"{country}{d(r.choice([18, 20, 22]))}"]), "Y": lambda: r.choice([f"{d(3)}-{d(2)}-{d(4)}", f"{d(2)} {d(3)} {d(3)} {d(3)}", f"{d(11)}", f"{d(3)}.{d(3)}.{d(3)}-{d(2)}"]),
        }
        return forms[r.choice("SQXLDBZY") if slot == "I" else slot]()

    def address(self) -> str:
        r, d = self.r, self.digits
        n = str(r.randint(1, r.choice([99, 399, 9999]))) + (r.choice("ABCDabc") if r.random() < 0.15 else "")
        proper = r.choice([r.choice(STREETS), r.choice(STREETS), r.choice(self.family)])
        street = f"{n} {r.choice(['', '', '', '', 'Old ', 'Upper ', 'New ', 'North ', 'W. '])}{proper} {r.choice(WAYS)}"
        tag = f"{r.choice(['Flat', 'Apt', 'Apt.', 'Unit', 'Suite', 'Apartment'])} {r.randint(1, 40)}{r.choice(['', '', 'B'])}"
        noun = r.choice(["Naranjo", "Olmo", "Fuente", "Molino", "Rosales", "Mayor", "de Alcalá", "del Carmen", "Libertad"])
        tree = r.choice(["Tilleuls", "Forges", "Lilas", "Peupliers", "Moulins", "Roses", "Paix", "Gare", "Victor Hugo", "Écoles", "Saint-Michel", "Jean-Jaurès", "Sainte-Anne", f"Saint-{r.choice(self.given)}"])
        link = r.choice(["des", "de la", "du", "de l'", "des"])
        stem = r.choice(["Mühlen", "Linden", "Garten", "Berg", "Schul", "Kirch", "Rosen", "Haupt", "Bahnhof", "Goethe"])
        end = r.choice(["straße", "gasse", "weg", "allee", "platz", "strasse", "str."])
        kind = r.choice(["rue", "avenue", "impasse", "boulevard", "chemin", "place", "Rue", "Avenue"])
        box = f"{r.choice(['PO Box', 'P.O. Box', 'P. O. Box', 'Postfach', 'Apartado', 'BP', 'Box', 'Casella Postale'])} {d(r.choice([3, 4, 5]))}"
        forms = [street] * 6 + [f"{street}, {tag}"] * 3 + [f"{tag}, {street}"] * 2 + [f"{street} #{r.randint(1, 40)}"] * 2 + [f"{street} {tag}", f"{n} {kind} {link} {tree}", f"{n}, {kind} {link} {tree}", f"{kind} {link} {tree} {n}", f"{n} {kind} des {tree}", f"{n} {kind} {tree}", f"{n} {kind} Saint-{r.choice(self.given)}"]
        forms += [f"{r.choice(['Calle', 'Avenida', 'Plaza', 'Paseo', 'C/'])} {noun}{r.choice([' ', ', '])}{n}"] * 2 + [f"{stem}{end} {n}"] * 3 + [f"{r.choice(['Via', 'Viale', 'Piazza', 'ul.', 'Rua', 'Calle'])} {r.choice([*STREETS, 'Roma', 'Garibaldi', 'Dante', 'Nowa', 'das Flores'])} {n}", box, box]
        text = r.choice(forms)
        return r.choices([text, text.lower(), text.upper()], [12, 1, 0.7])[0]

    def fill(self, pattern: str) -> tuple[str, list[tuple[int, int, str]]]:
        r = self.r
        if r.random() < OTHERWISE:
            for slot, other in OTHERS.items():
                pattern = pattern.replace("{" + slot + "}", f"({other})" if "(" not in other else r.choice(_top_level(other)))
        while m := _CHOICE.search(pattern):
            pattern = pattern[: m.start()] + r.choice(m[1].split("|")) + pattern[m.end() :]
        pattern = pattern.replace("\\", "").replace("  ", " ")
        out, spans, i = "", [], 0
        while i < len(pattern):
            end = pattern.find("}", i)
            if pattern[i] != "{" or end < 0:
                out += pattern[i]
                i += 1
                continue
            slot = pattern[i + 1 : end]
            i = end + 1
            kind = KIND_OF.get(slot)
            if kind:
                value = {"name": self.name, "email": self.email, "phone": self.phone, "address": self.address}[kind]() if kind != "id_number" else self.identity(slot)
                spans.append((len(out), len(out) + len(value), kind))
            else:
                value = self.word(slot)
            out += value
        return out, spans

    def unknown(self) -> str:
        """A word in lower case that the table hardly holds twice, or a common one."""
        r = self.r
        if r.random() < 0.4:
            return r.choice(r.choice([NOUNS, ADJECTIVES, VERBS]))
        stem = "".join(r.choice(["b", "br", "c", "ch", "cl", "d", "dr", "f", "fl", "g", "gr", "h", "j", "k", "l", "m", "n", "p", "pl", "qu", "r", "s", "sh", "sl", "st", "t", "th", "tr", "v", "w", "z", ""]) + r.choice("aeiouaeiy") + r.choice(["", "", "n", "r", "l", "t", "ck", "m", "sh", "st", "nd", "p"]) for _ in range(r.choice([1, 1, 2, 2, 3])))
        return stem + r.choice(["", "", "", "s", "s", "ing", "ed", "er", "ly", "y", "ion", "ness", "le", "et", "al", "ous", "ive", "age", "en"])

    def babble(self, n: int) -> str:
        """`n` words of no meaning, about half of them of the language's frame."""
        r = self.r
        return " ".join(r.choice(FRAME) if r.random() < 0.55 else self.unknown() for _ in range(n))

    def word(self, slot: str) -> str:
        r = self.r
        if slot[0] == "d":
            return self.digits(int(slot[1:]))
        if slot == "BABBLE":
            return self.babble(r.randint(1, 9))
        if slot == "FOREIGN":
            text = " ".join(r.choice(FOREIGN) if r.random() < 0.5 else self.unknown() + r.choice(["", "o", "a", "é", "en", "e", "ón", "ère"]) for _ in range(r.randint(3, 12)))
            return text[:1].upper() + text[1:]
        if slot == "SPACED":
            return " ".join(self.unknown()[:9])
        if slot == "JUNK":
            return " ".join("".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(r.randint(2, 8))) for _ in range(r.randint(3, 20)))
        if slot == "CODE":
            return "".join(r.choice("abcdefghijkmnpqrstuvwxyz0123456789") for _ in range(r.randint(5, 11)))
        if slot == "SERIES":
            return " ".join(self.digits(r.choice([3, 4, 4])) for _ in range(r.randint(6, 24)))
        return {
            "n": lambda: r.choice(NOUNS), "N": lambda: r.choice(NOUNS).title(), "a": lambda: r.choice(ADJECTIVES), "A": lambda: r.choice(ADJECTIVES).title(), "v": lambda: r.choice(VERBS), "p": lambda: r.choice(PLACES), "P": lambda: r.choice([*PLACES, self.brand()]), "w": self.brand, "t": lambda: r.choice(TITLED),
            "h": lambda: r.choice([r.choice(NOUNS), r.choice(self.given)]) + r.choice(["", "_", "x"]) + self.digits(2), "l": lambda: self.brand().lower(), "g": lambda: r.choice(self.given), "f": lambda: r.choice(self.family), "L": self.letter, "u": self.unknown, "J": lambda: r.choice("abcdefghijkl"), "W": lambda: (r.choice(r.choice([NOUNS, ADJECTIVES, VERBS])) if r.random() < 0.7 else self.unknown()).title(),
        }[slot]()

    def text(self) -> tuple[str, list[tuple[int, int, str]]]:
        """One to four sentences, begun, ended, separated and cased in various ways."""
        r = self.r
        out, spans = "", []
        if r.random() < 0.15:
            out = r.choice(["@garden42 ", "RT @paper: ", "note: ", "@rusty77, ", "well, ", "1/ ", "\"", "> "])
        for k in range(r.choice([1, 2, 2, 3, 4])):
            group = r.choices([g for g, _ in GROUPS], [w for _, w in GROUPS])[0]
            text, found = self.fill(r.choice(group))
            casing = r.random()
            if not found and casing < 0.16:
                text = r.choice([text.upper(), text.title(), text.lower()])
            elif found and casing < 0.06 and len(text.upper()) == len(text):
                text = r.choice([text.upper(), text.lower()])
            elif text[:1].islower() and casing < 0.6 and not (found and found[0][0] == 0):
                text = text[:1].upper() + text[1:]
            if k:
                out += r.choice([" ", " ", " ", "\n", "  ", ""]) if out[-1:] in ".!?… " else r.choice([" ", "\n", "  "])
            spans += [(a + len(out), b + len(out), kind) for a, b, kind in found]
            out += text + r.choice([".", ".", "!", "", "", "…", "?", " ", "...", ",", " -"])
        if r.random() < 0.1 and len(out.upper()) == len(out):
            out = r.choice([out.upper(), out.title(), out.lower()])
        return out, spans


def _top_level(pattern: str) -> list[str]:
    """Alternatives of a pattern that are not within parentheses."""
    parts, depth = [""], 0
    for c in pattern:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return parts


def _plain(name: str) -> str:
    return re.sub(r"[^a-z]", "", name.lower().translate(str.maketrans("üöäéèñ", "uoaeen"))) or "x"


def made_names(n: int, ends: list[str], seed: int) -> list[str]:
    r = random.Random(seed)
    out = []
    for i in range(n):
        if i % 2:
            out.append(r.choice(STARTS) + r.choice(["", *MIDDLES]) + r.choice(ends))
        else:  # of no pattern
            out.append("".join(r.choice(["b", "ch", "d", "f", "g", "gh", "h", "j", "k", "kh", "l", "m", "n", "p", "r", "s", "sh", "t", "v", "w", "y", "z", "xi", "th"]) + r.choice(["a", "e", "i", "o", "u", "aa", "ie", "ou"]) + r.choice(["", "", "n", "r", "l", "s", "m", "k"]) for _ in range(r.choice([2, 2, 3]))).title())
    return out


def people(seed: int = 5) -> tuple[list[str], list[str]]:
    """Given and family names of the table: common ones and as many made-up ones."""
    return GIVEN + made_names(900, GIVEN_ENDS, seed), FAMILY + made_names(900, FAMILY_ENDS, seed + 1)


def labelled_table(given: list[str], family: list[str], rows: int = 2600, seed: int = 5) -> list[tuple[str, list[tuple[int, int, str]]]]:
    maker = Maker(given, family, seed)
    return [maker.text() for _ in range(rows)]
