"""Scores for abusive, hateful and sexual content: gradient-boosted trees over dense features, with isotonic calibration.

A text is scored by its worst passage: a sentence or line, or one of the overlapping windows of WINDOW words of a longer one.
Every passage is scored, whether or not it holds a word of a lexicon. Words that are spelled to escape notice (other
alphabets' look-alikes, digits and signs for letters, masked, spaced or repeated letters, invisible characters) are restored
first, if that gives a word of the lexicons; how often that was needed is a feature. Dense features of a window: hits and
densities by lexicon, hits near a second person, a first person or a named group, capitals, punctuation and obfuscation
rates, and densities of hashed word and letter n-grams weighted by how much likelier they are in examples with a category.
The n-gram weights that the trees see in training come from other folds, and folds keep examples of one wording together,
so that the trees learn how far such weights hold for unseen wordings. The trees are trained here, on a bounded sample of
labelled examples (MOST_EXAMPLES, smallest hashes first), and calibrated by isotonic regression on scores of examples that
each fold's trees haven't seen. The lexicons are general vocabulary of four languages, single words only, that make features;
the labels decide what they mean.

Cases: null and blank texts have the base score, that of a passage without any hit. Examples without text or category are
left out; with fewer than two classes the model can't be trained and an error says so. Texts are read whole. Extra columns
are ignored. Rows repeated under one id count once, rows without an id each count.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.wordhash import mix, powers
from fathomline.storage import spread

MOST_EXAMPLES = 20_000
TREES, DEPTH, RATE, LEAST_LEAF, FOLDS = 80, 3, 0.15, 3, 5
#: Columns and rows that each tree sees.
#: How often the passage of an example that is most like a case is chosen anew.
ROUNDS = 3
COLUMN_SHARE, ROW_SHARE = 0.3, 0.7
#: The calibrated probability from which a text counts as a case.
THRESHOLD = 0.5
#: Words of a window, and from one window to the next; what is said within WINDOW - STEP words is whole in a window.
WINDOW, STEP = 24, 8
#: Words between a hit and the person or group it is aimed at, at most.
REACH, GROUP_REACH = 5, 8
#: Passages of the usual mix that an n-gram's own passages are smoothed by.
SMOOTH = 5
#: Examples whose label is less likely than that by trees of the other folds are taken for labelled wrongly and left out.
WRONG = 0.1
#: Characters that are handled at once, and of a passage before it is cut (with WINDOW words repeated).
CHARS = 1 << 20

# General vocabulary in English, Spanish, French and German, lower case, without accents. A sign after a word adds
# endings: + English (s, es, ed, ing), ~ Romance gender and number (o, a, os, as, e, es, s), = German (e, en, er, es, em, s, n).
LEXICONS = {
    "insult": """idiot+ moron+ imbecile+ asshole+ arsehole+ bastard+ dickhead+ loser+ scumbag+ dimwit+ bitch+ fucker+ motherfucker+ cunt+ twat+ wanker+ prick+ jackass+ dumbass+
retard+ halfwit+ cretin+ douchebag+ shithead+ fool+ clown+ coward+ creep+ pig+ dog+ donkey+ muppet+ numpty tosser+ git+ plonker+ nitwit+ blockhead+ bonehead+ airhead+ simpleton+ dunce+ weirdo+
freak+ jerk+ liar+ maggot+ worm+ weasel+ crybaby whore+ slut+ hag+ turd+ scrub+ failure+ disgrace trash garbage waste piece dumbo dolt+ oaf+ lowlife+ leech+ rat+ snake+ scoundrel+ ass
idiota+ imbecil imbeciles gilipollas pendej~ cabron cabrones put~ hijueputa tarad~ estupid~ mierd~ subnormal+ capull~ payas~ cretin~ bob~ tont~ zorra+ perra+ cerd~ burr~ inutil inutiles basura desgraciad~ maric~ maricon
connard+ connasse+ abruti~ cretin~ encule~ salaud+ salope+ batard+ ordure+ imbecile+ debile+ tocard+ conne+ bouffon~ clochard+ pourriture raclure minable+ rate~ cretine+ andouille+ crapule+ garce+ porc+ merde+ merdeu~
arschloch arschlocher wichser= vollpfosten vollidiot= trottel= depp= mistkerl= dreckskerl= hurensohn= schlampe= schwachkopf penner= missgeburt= spast= idiot= dummkopf= versager= arsch feigling= schwein= sau drecksau hund= esel= spinner= nichtsnutz= lump= bastard= nutte= hure= fotze= loser= clown= blodmann""",
    "degrade": """stupid pathetic worthless useless disgusting filthy brainless goddamn fucking dirty ugly dumb clueless miserable repulsive vile damn damned bloody rotten lousy stinking lazy ignorant incompetent
hopeless shitty crappy idiotic moronic spineless gutless talentless repugnant revolting hideous fat smelly slimy nasty sick whining whiny stink+ cowardly hateful sad sorry
maldit~ asqueros~ inutil inutiles miserable+ suci~ pobre+ fe~ patetic~ repugnante+ jodid~ vag~ ignorante+ estupid~ imbecil despreciable+ inmund~ apestos~
sale+ pauvre+ minable+ putain pourri~ degueulasse+ stupide+ debile+ lamentable+ pathetique+ inutile+ degoutant~ moche+ laid~ nul~ ignoble+ miserable+ foutu~ sot+ bete
verdammt= dreckig= dumm= blod= elend= widerlich= nutzlos= erbarmlich= hasslich= ekelhaft= faul= wertlos= stinkend= jammerlich= dammlich= bescheuert= armselig= verflucht= mies= peinlich= unfahig= verfickt=""",
    "contempt": """hate+ hates despise+ loathe+ disgust+ laugh+ mock+ pity shut hell rot choke+ vomit puke+ shame screw fuck piss suck+ sucks crawl drop dead disappear vanish nobody noone sick tired fed lost rock cry
burden regret mistake garbage vomit spit+ ruin+ deserve+ unwanted unloved stfu gtfo kys wtf
mierda vete infierno callate calla asco pudras pudrete nadie soporta muerete jodete joder odio odia largo largate fuera cierra boca desprecio verguenza
foutre ferme gueule creve crever degage casse degoute+ degoutes personne mourir deteste honte taire tais enfer vomir pue hais barre
fick fickt fresse halt maul klappe verrecke verpiss verschwinde ekel ekelst leck hasse hass stirb sterben teufel niemand holle scher hau schnauze kotz kotzt schamen scham krepier verachte""",
    "violence": """kill+ murder+ stab+ shoot+ punch+ slap+ beat+ smash+ break+ cut+ hurt+ burn+ drown+ hang+ strangle+ choke+ rape+ hunt+ destroy+ crush+ kick+ hit+ bomb+ attack+ torture+ bury throw+ whip+ slaughter+ lynch+ behead+ knife gun throat bones
fingers teeth skull neck legs face blood suicide 
mata+ matar matare matarte romper romperte golpear golpearte pegar quemar quemarte ahogar ahorcar colgar violar apunalar disparar partir partirte destrozar dientes cara cuello piernas huesos sangre suicidate
tuer tue tuerai buter frapper casser bruler noyer pendre etrangler violer poignarder egorger ecraser demolir exploser dents figure gorge jambes sang suicide
toten tote umbringen bringe bring schlag= schlagen brechen breche brech verbrennen erhangen erwurgen erstechen erschiessen ertranken aufschlitzen zahne knochen kehle hals gesicht blut umlegen abstechen prugeln""",
    "group": """foreigner+ immigrant+ migrant+ newcomer+ refugee+ stranger+ outsider+ believer+ religion+ faith+ race+ minority minorities ethnic tribe+ nation+ folk gays lesbians women jews muslims christians blacks whites arabs asians africans mexicans gypsies people kind
homosexuals transgender natives savages infidels heathens caste
extranjer~ inmigrante+ fe creyente+ refugiad~ musulman~ musulmanes judi~ gitan~ mujeres negr~ arabes minoria+ raza+ gente moros sudacas
etranger~ immigre~ croyant~ refugie~ musulman~ juif+ juive+ gens arabe+ noirs femmes minorite+ race+ roms peuple+
auslander= fremde= fluchtling= glaubige= migrant= jude= moslem= muslim= frauen leute volk minderheit= rasse= zigeuner= schwarze= asylant= turken araber""",
    "dehumanise": """vermin parasite+ subhuman+ filth plague+ rat+ scum criminal+ animal+ poison+ disease+ cockroach+ savage+ degenerate+ inferior swine+ infest+ infestation pest+ pigs dogs monkey+ ape+ insect+ virus cancer leech+ beast+ demon+ devil+ trash garbage evil uncivilised uncivilized barbarian+ thieves invaders
escoria plaga+ rata+ parasit~ infrahuman~ animal+ animales basura cucaracha+ alimana+ inferior+ inferiores bestia+ salvaje+ cancer veneno monos criminales delincuentes cerdos peste
parasite+ vermine hommes nuisible+ racaille+ cafard+ plaie+ rat+ bete+ animaux inferieur+ sauvage+ ordures peste cancer singe+ criminels poison envahisseurs chiens
ungeziefer untermensch= schmarotzer= parasit= abschaum plage ratte= pest tier= seuche krebs affe= minderwertig= kriminelle= verbrecher= gesindel pack schadlinge kakerlake=""",
    "expel": """exterminate+ eradicate+ wiped wipe eliminate+ deport+ expel+ banish+ throw+ burn+ hang+ gas dead kill+ shot remove cleanse+ purge+ ban+ banned hire unwelcome segregate+ sterilise+ sterilize+ annihilate+ gone belong rid back country homes homeland borders hates
exterminar exterminarlos eliminar eliminarlos expulsar expulsarlos echar echarlos fuera quemar quemarlos muertos muerte matar matarlos merecen deportar deportarlos pais
exterminer eliminer dehors bruler brulez renvoyer renvoyez expulser expulsez chasser pendre morts mort meritent crevent deporter pays gazer
ausgerottet ausrotten raus vernichten vernichtet verbrennen brennen abschieben verdienen leben tot toten hangen vergasen vertreiben land ausweisen erschossen gehoren""",
    "sexual": """porn porno nude+ nudes tit tits titties titty boob+ orgasm+ horny panties xxx cam+ blowjob+ handjob+ threesome+ uncensored hardcore busty fuck fucks fucked fucking cock+ dick+ pussy pussies clit cum cumming anal masturbate+ masturbat+ masturbating erection+ slut+ whore+ milf+ escort+ hooker+
erotic naked nipple+ penis vagina ejaculate+ dildo+ vibrator+ striptease stripper+ bdsm kinky fetish+ creampie gangbang orgy orgies incest moan+ thrust+ undress+ sex sexy bra bras lingerie topless jerk wank+ lick+ suck+ sucking seduce+ aroused arousal deepthroat cumshot hentai camgirl+ onlyfans hottie+ playmate+ virgin+ upskirt
teta+ tetas folla+ follar follame follando desnud~ polla+ cono orgasmo+ cachond~ video muslos pezon pezones gemir chupar chupa mamada+ porno sexo culo+ verga+ maduras cachondas xxx erotic~ puta+ corrida+ masturb~ masturbarse calient~ braga+ bragas
sein+ nue+ nues nus baiser baise+ bite+ chatte+ orgasme+ cuisses gemit gemissait sexe porno coquin~ sucer suce+ pipe+ salope+ chaude+ erotique+ culotte+ jouir jouissance masturb~ branler penetrer penetre cul culs fesses string
titte= ficken fickt gefickt nackt= muschi= schwanz orgasmus geil= stohnte stohnen blasen porno= pornos sex erotik erotisch= hure= schenkel bruste busen votze hoschen slip wichsen nippel unzensiert hardcore nutte= vogeln bumsen""",
    "intimate": """breast+ breasts thigh+ lips tongue bed kiss+ kissed bare hot hard skin mouth body bodies tonight singles desire strip+ touch+ slid pulled off inside girls wives videos pics photos clips adult+ explicit live watch free call desk hands pants skirt lust
pecho+ labios lengua cama beso+ besar boca cuerpo noche chicas mojada caliente piel duro duros gratis fotos videos maduras desnudo
levres langue lit bouche corps nuit filles mouillee peau nuit photos videos chaudes gratuit~ censure dur femmes
lippen zunge bett kussen mund korper nacht madchen nass haut bilder videos heiss= kostenlos zensur frauen""",
    "about": """guide+ guideline+ moderation moderator+ rule+ word+ insult+ explain+ says said called reporter+ journalist+ historian+ describe+ propaganda museum+ scholar+ scholarly scholars leaflet clinic+ clinical screening health medical medicine doctor+ nurse+ training harassment policy policies process processes worker+ server+ pointer+ bug+
terminal study studies research researcher+ court+ police patient+ symptom+ therapy treatment diagnosis definition dictionary quote+ quoted term+ example+ report+ article+ law+ legal victim+ survivor+ awareness education school+ teacher+ lesson+ art painting+ sculpture novel+ chapter+ biology species farm+ animal+ cell+ cells infection+ vaccine+ virus
software code child parent thread+ signal+ command+ script+ job+ jobs system machine+ engine tool+ panel screws dust weather river film+ movie+ review+ book+ poem+ complaint+ against condemn+ condemned ban prevent+ protect+ support+
guia moderacion insulto+ palabra+ explica salud taller proceso+ reiniciar reinicie museo historiador+ historiadores folleto estudio+ medic~ clinica policia ley diccionario termino periodista+ informe sistema educacion
mot+ retire explique sante brochure+ processus relancez relancer musee historien+ decrit etude+ medecin clinique police loi dictionnaire terme journaliste rapport systeme education
regel= wort= worter= geloscht erklart erklaren gesundheit broschure prozess kindprozess neustart museum historiker leitfaden studie arzt klinik polizei gesetz worterbuch begriff bericht system moderation""",
    "second": """you your yours yourself yourselves youre youve youll u ur thou thee
du dich dir dein deine deiner deinen deinem deines ihr euch euer eure
tu te toi ton ta tes t vous votre vos vete callate ere eres ti tus contigo usted vosotros ustedes os""",
    "first": """i me my mine myself we us our ill ive id will gonna yo mi me voy vamos nos nosotros quiero je j moi mon ma mes vais nous ich mich mir mein meine meiner wir uns werde werden""",
    "sweeping": """all every everyone everybody nobody none only never always whole no any such them they their those these must should would
todos todas todo nadie nunca siempre solo ellos ellas esos hay ese esa
tous toutes tout personne jamais toujours ils elles ces ceux ce faut
alle alles niemand nie nur immer sie diese dieser jeder keiner muss man""",
}
NAMES = list(LEXICONS)
HITS = NAMES[: NAMES.index("about")]
ENDINGS = {"+": ("", "s", "es", "ed", "d", "ing"), "~": ("", "o", "a", "os", "as", "e", "es", "s"), "=": ("", "e", "en", "er", "es", "em", "s", "n")}

# Characters that look like Latin letters, and signs that stand for letters.
LOOKALIKES = dict(zip("авеёзіїјкмнорстухѕԁԛԝһΑΒΕΖΗΙΚΜΝΟΡΤΥΧАВЕЗІЈКМНОРСТУХЅαεικνορτυχο", "abee3iijkmhopctyxsdqwhABEZHIKMNOPTYXABE3IJKMHOPCTYXSaeiknoptuxo", strict=False))
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "$": "s", "@": "a", "!": "i", "+": "t", "l": "i"}
WILD = "#*_"

_ODD = re.compile(r"(?<![a-z0-9#*_$@+!])[a-z]*+[0-9#*_$@+!][a-z0-9#*_$@+!]*+")
_SPACED = re.compile(r"(?<![a-z])[a-z](?:([-. _*])[a-z])(?:\1[a-z]){1,30}(?![a-z])")
_MASKED = re.compile(r"(?<![a-z])[a-z]+-[a-z]+(?![a-z])")
_LONG = re.compile(r"(?<![a-z])[a-z]*?([a-z])\1\1[a-z]*")
_RUN = re.compile(r"([a-z?])\1+")
_FOREIGN = re.compile("[­Ā-֏​-⁤﻿]")
_PASSAGES = re.compile(r"(?<=[.!?…])\s+|[\n\r\v\f\x1c-\x1e\x85  ]+|(?<=[\U0001f300-\U0001faff])\s+")
_EMOJI = re.compile("[\U0001f300-\U0001faff☀-➿]")
_SIGNS = str.maketrans(SIGNS)
_WILD = str.maketrans(dict.fromkeys(WILD, "?"))
_BESIDE = np.isin(np.arange(256), [ord(c) for c in "0123456789#*_$@+!-"])
_BETWEEN = np.isin(np.arange(256), [ord(c) for c in "-. _*"])
_PUNCTUATION = np.isin(np.arange(256), [ord(c) for c in ".,;:?-*#$@_"])
_U = np.uint64
#: Follows a restored word.
_MARK = "\x01"


@lru_cache(1)
def _fold() -> dict[int, str | None]:
    """Accented and look-alike characters to plain ones, invisible ones to nothing."""
    out: dict[int, str | None] = {}
    for c in range(0xA0, 0x250):
        plain = "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x))
        if plain != chr(c) and plain.isascii():
            out[c] = plain
    out |= {ord(k): v for k, v in LOOKALIKES.items()} | {ord("ß"): "ss", ord("ł"): "l", ord("ø"): "o", ord("’"): "'"}
    out |= dict.fromkeys([0xAD, *range(0x200B, 0x2010), *range(0x2060, 0x2065), 0xFEFF, *range(0x300, 0x370)])
    return out


@lru_cache(1)
def entries() -> dict[str, int]:
    """The words of the lexicons, with the lexicons that hold them as bits."""
    out: dict[str, int] = {}
    for k, words in enumerate(LEXICONS.values()):
        for w in words.split():
            for end in ENDINGS.get(w[-1], ("",)):
                form = w.rstrip("+~=") + end
                out[form] = out.get(form, 0) | 1 << k
    return out


def _skeleton(word: str) -> str:
    """A word as it looks: signs as letters, runs of one letter as one."""
    return _RUN.sub(r"\1", word.translate(_SIGNS))


@lru_cache(1)
def _spellings() -> tuple[dict[str, str], dict[tuple[str, int], list[str]]]:
    """Single abusive, hateful and sexual words of at least four letters by skeleton, and by first letter and length."""
    bits = sum(1 << NAMES.index(n) for n in ("insult", "degrade", "dehumanise", "sexual"))
    words = sorted(w for w, b in entries().items() if b & bits and len(w) >= 4)
    by_look: dict[str, str] = {}
    by_size: dict[tuple[str, int], list[str]] = {}
    for w in words:
        by_look.setdefault(_skeleton(w), w)
        by_size.setdefault((w[0].translate(_SIGNS), len(w)), []).append(w)
    return by_look, by_size


@lru_cache(1 << 16)
def plain(token: str) -> str | None:
    """The word of the lexicons that a token with signs, digits or masked letters stands for."""
    by_look, by_size = _spellings()
    for t in (token, token.rstrip("!+")):
        if not any(c in WILD for c in t):
            if (w := by_look.get(_skeleton(t))) is not None:
                return w
            continue
        seen = t.translate(_WILD).translate(_SIGNS)
        if 2 * seen.count("?") < len(seen) and seen[:1] != "?":
            for w in by_size.get((seen[0], len(seen)), ()):
                if all(a in ("?", b) for a, b in zip(seen, w.translate(_SIGNS), strict=True)):
                    return w
    return None


def _odd(m: re.Match) -> str:
    if not any(c.isalpha() for c in m[0]) or not (w := plain(m[0])):
        return m[0]
    return w + _MARK


def _spaced(m: re.Match) -> str:
    """The longest run of the single letters that is a word; an article may stand before it."""
    looks, sign, letters = _spellings()[0], m[1], m[0].split(m[1])
    for n in range(len(letters), 3, -1):
        for at in range(len(letters) - n + 1):
            if (w := looks.get(_skeleton("".join(letters[at : at + n])))) is not None:
                return sign.join([*letters[:at], w + _MARK, *letters[at + n :]])
    return m[0]


def _masked(m: re.Match) -> str:
    w = plain(m[0].replace("-", "*")) if len(m[0]) >= 5 else None
    return w + _MARK if w and len(w) == len(m[0]) else m[0]


def _long(m: re.Match) -> str:
    w = _spellings()[0].get(_skeleton(m[0]))
    return w + _MARK if w else m[0]


def folded(text: str) -> str:
    """The text in plain letters."""
    if text.isascii():
        return text
    if _FOREIGN.search(text):
        text = text.translate(_fold())
    for mark, other in (("ß", "ss"), ("’", "'"), ("–", " "), ("—", " "), ("\xa0", " ")):
        text = text.replace(mark, other)
    return unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()


def restored(text: str) -> str:
    """A text in plain letters in small letters, disguised words spelled out with a mark behind each. Line feeds stay where they are."""
    low = text.lower().replace(_MARK, " ")
    codes = np.frombuffer(low.encode("latin-1", "replace"), np.uint8)
    some = _suspicious(codes)
    if not len(some):
        return low
    # only lines that hold what a disguise needs are searched for them
    ends = np.append(np.flatnonzero(codes == 10), len(codes))
    lines = low.split("\n")
    for k in np.unique(np.searchsorted(ends, some)).tolist():
        lines[k] = _LONG.sub(_long, _MASKED.sub(_masked, _ODD.sub(_odd, _SPACED.sub(_spaced, lines[k]))))
    return "\n".join(lines)


def _suspicious(codes: np.ndarray) -> np.ndarray:
    """Places of a letter beside a sign or hyphen, of three single letters apart, or of a letter three times in a row."""
    letter = (codes >= 97) & (codes <= 122)
    if len(codes) < 3:
        return np.flatnonzero(letter)
    sign = _BESIDE[codes]
    found = (letter[:-1] & sign[1:]) | (sign[:-1] & letter[1:])
    found[:-1] |= letter[:-2] & (codes[:-2] == codes[1:-1]) & (codes[1:-1] == codes[2:])
    apart = letter[:-2] & _BETWEEN[codes[1:-1]] & letter[2:]
    found[: len(apart) - 2] |= apart[:-2] & apart[2:]
    return np.flatnonzero(found)


def passages(text: str) -> list[str]:
    """Sentences and lines that hold anything; parts with WINDOW words in common of those of more than CHARS characters."""
    out = []
    for p in _PASSAGES.split(text):
        if len(p) > CHARS:
            words = p.split()
            out += [" ".join(words[max(0, a - WINDOW) : a + CHARS // 16]) for a in range(0, len(words), CHARS // 16)]
        elif p and not p.isspace():
            out.append(p)
    return out


@dataclass
class Words:
    """The words of passages, one after another."""

    hashes: np.ndarray
    bits: np.ndarray  # the lexicons that hold each word
    restored: np.ndarray
    first: np.ndarray  # of each passage, its first word
    size: np.ndarray
    letters: np.ndarray  # codes of all letter 4-grams in order
    spans: np.ndarray  # where each word's 4-grams start


@lru_cache(1)
def _known() -> tuple[np.ndarray, np.ndarray]:
    found = entries()
    h = _hashes(np.frombuffer(" ".join(found).encode(), np.uint8))[0]
    order = np.argsort(h)
    return h[order], np.array(list(found.values()), np.int64)[order]


def _hashes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every run of small letters."""
    inside = (codes >= 97) & (codes <= 122)
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    values, up, down = powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(values[codes] * up[: len(codes)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts, ends


def look_up(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The value of each asked key in rising keys, 0 if it isn't there."""
    if not len(keys):
        return np.zeros(len(asked), values.dtype)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], values.dtype.type(0))


def words_of(found: list[str]) -> Words:
    low = restored("\n".join(folded(p).replace("\n", " ") for p in found))
    codes = np.frombuffer((low + "\n   ").encode(), np.uint8)
    hashes, starts, ends = _hashes(codes)
    lines = np.append(np.flatnonzero(codes == 10)[: len(found)], len(codes))
    size = np.diff(np.searchsorted(starts, lines[: len(found)]), prepend=0)
    wide = codes.astype(np.uint32)
    wide[(codes < 97) | (codes > 122)] = 32
    grams = wide[:-3] | wide[1:-2] << 8 | wide[2:-1] << 16 | wide[3:] << 24
    return Words(hashes, look_up(*_known(), hashes), codes[ends] == 1, np.cumsum(size) - size, size, grams, starts)


def near(a: np.ndarray, b: np.ndarray, first: np.ndarray, last: np.ndarray, reach: int) -> np.ndarray:
    """Words with a that have b within reach, in the same passage. first, last: the first word of each word's passage, and behind its last."""
    place = np.arange(len(a))
    before = np.maximum.accumulate(np.where(b, place, -(1 << 40)))
    after = np.minimum.accumulate(np.where(b, place, 1 << 40)[::-1])[::-1]
    return a & (((place - before <= reach) & (before >= first)) | ((after - place <= reach) & (after < last)))


#: Which lexicon's hits are looked for near which other's, and how near.
PAIRS = [("insult", "second", REACH), ("degrade", "second", REACH), ("contempt", "second", REACH), ("violence", "second", REACH), ("violence", "first", REACH), ("insult", "degrade", 2), ("contempt", "insult", REACH),
         ("dehumanise", "group", GROUP_REACH), ("expel", "group", GROUP_REACH), ("degrade", "group", GROUP_REACH), ("violence", "group", GROUP_REACH), ("sexual", "intimate", REACH), ("sexual", "second", REACH), ("insult", "about", GROUP_REACH), ("sexual", "about", GROUP_REACH), ("violence", "about", GROUP_REACH)]
COLUMNS = [*NAMES, *(f"{n}_density" for n in HITS), *(f"{a}_near_{b}" for a, b, _ in PAIRS), "words_for", "words_against", "letters_for", "letters_against", "strongest", "restored", "restored_rate", "n_words", "kinds", "capitals", "exclamations", "punctuation", "emoji"]
#: Features of which more never make a passage less of a case.
RISING = [k for k, c in enumerate(COLUMNS) if c in (*HITS, "words_for", "letters_for", "strongest") or c.endswith(("near_second", "near_group", "near_first", "insult_near_degrade"))]


@dataclass
class Weights:
    """How much likelier word and letter n-grams are in examples with a category: logarithms by rising hash."""

    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    word_weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    letters: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))
    letter_weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))


def _pairs_of(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of neighbouring words of one passage, and the place of the first of each."""
    if len(w.hashes) < 2:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = np.ones(len(w.hashes), bool)
    inside[w.first[w.size > 0][1:] - 1] = False
    at = np.flatnonzero(inside[:-1])
    return mix(w.hashes[at] * _U(0x9E3779B97F4A7C15) + w.hashes[at + 1]), at


def _letters_of(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the 4-grams from the blank before each word to the one behind it, and their words."""
    if not len(w.hashes):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    start = np.maximum(w.spans - 1, 0)
    owner = np.repeat(np.arange(len(start)), np.diff(np.append(start, min(len(w.letters), int(w.spans[-1]) + 24))))
    codes = w.letters[start[0] : start[0] + len(owner)]
    whole = (codes >> 8 & 0xFF != 32) & (codes >> 16 & 0xFF != 32)
    return codes[whole], owner[whole]


def weigh(found: list[str], case: np.ndarray) -> Weights:
    """The weights of n-grams of passages of which some are cases."""
    w = words_of(found)
    owner = np.repeat(np.arange(len(found)), w.size)
    pairs, at = _pairs_of(w)
    codes, of = _letters_of(w)

    def ratio(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        once = np.unique(np.stack([keys.astype(np.uint64), owners.astype(np.uint64)]), axis=1)  # n-grams count once a passage
        names, place = np.unique(once[0], return_inverse=True)
        yes = case[once[1].astype(np.int64)]
        n1, n0 = np.bincount(place[yes], minlength=len(names)), np.bincount(place[~yes], minlength=len(names))
        share = float(np.clip(case.mean(), 0.01, 0.99))
        return names, np.log((n1 + SMOOTH * share) / (n1 + n0 + SMOOTH) / share).astype(np.float32)

    words, word_weights = ratio(np.concatenate([w.hashes, pairs]), np.concatenate([owner, owner[at]])) if len(w.hashes) else (np.zeros(0, np.uint64), np.zeros(0, np.float32))
    letters, letter_weights = ratio(codes, owner[of]) if len(codes) else (np.zeros(0, np.uint64), np.zeros(0, np.float32))
    return Weights(words, word_weights, letters.astype(np.uint32), letter_weights)


def features(found: list[str], weights: Weights) -> tuple[np.ndarray, np.ndarray]:
    """The features of every window of the passages, one row each, and the windows' passages."""
    w = words_of(found)
    some = w.size > 0
    n_windows = np.where(some, 1 + -(-np.maximum(w.size - WINDOW, 0) // STEP), 0)
    owner = np.repeat(np.arange(len(found)), n_windows)
    if not len(owner):
        return np.zeros((0, len(COLUMNS)), np.float32), owner
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    size = w.size[owner]
    start = w.first[owner] + np.clip(nth * STEP, 0, np.maximum(size - WINDOW, 0))
    end = start + np.minimum(size, WINDOW)
    total = (end - start).astype(np.float32)

    def summed(x: np.ndarray) -> np.ndarray:
        sums = np.concatenate([np.zeros(1), np.cumsum(x, dtype=np.float64)])
        return (sums[end] - sums[start]).astype(np.float32)

    held = {n: (w.bits >> k & 1).astype(bool) for k, n in enumerate(NAMES)}
    word_owner = np.repeat(np.arange(len(found)), w.size)
    first, last = w.first[word_owner], (w.first + w.size)[word_owner]
    counts = [summed(held[n]) for n in NAMES]
    out = [*counts, *(c / (total + 3) for c in counts[: len(HITS)])]
    out += [summed(near(held[a], held[b], first, last, reach)) for a, b, reach in PAIRS]
    own = look_up(weights.words, weights.word_weights, w.hashes)
    pairs, at = _pairs_of(w)
    own[at] += look_up(weights.words, weights.word_weights, pairs)
    codes, of = _letters_of(w)
    by_letters = np.bincount(of, look_up(weights.letters, weights.letter_weights, codes), minlength=len(w.hashes)).astype(np.float32)
    pos, neg, lpos, lneg = np.maximum(own, 0), np.minimum(own, 0), np.maximum(by_letters, 0), np.minimum(by_letters, 0)
    strongest = np.maximum.reduceat(np.append(pos, 0), np.stack([start, end], 1).ravel())[::2]
    odd = summed(w.restored)
    kinds = sum((c > 0).astype(np.float32) for c in counts[: len(HITS)])
    out += [summed(pos) / np.sqrt(total), summed(neg) / np.sqrt(total), summed(lpos) / np.sqrt(total), summed(lneg) / np.sqrt(total), strongest, odd, odd / total, total, kinds]
    return np.concatenate([np.stack(out, 1), _looks(found)[owner]], 1), owner


def _looks(found: list[str]) -> np.ndarray:
    """Of each passage, the share of capitals, exclamation marks, the share of other signs, any emoji."""
    codes = np.frombuffer("\n".join(p.replace("\n", " ") for p in [*found, ""]).encode("latin-1", "replace"), np.uint8)
    ends = np.flatnonzero(codes == 10)[: len(found)]

    def count(which: np.ndarray) -> np.ndarray:
        return np.diff(np.cumsum(which)[ends], prepend=0)

    size = np.maximum(np.diff(ends, prepend=-1) - 1, 1)
    capitals = (codes >= 65) & (codes <= 90) | (codes >= 192) & (codes <= 222) & (codes != 215)
    emoji = [not p.isascii() and bool(_EMOJI.search(p)) for p in found]
    return np.stack([count(capitals) / size, count(codes == 33), count(_PUNCTUATION[codes]) / size, emoji], 1).astype(np.float32)


def in_blocks(texts: list[str | None]) -> Iterator[tuple[list[str], np.ndarray]]:
    """The passages of texts with the texts' places, some CHARS characters at a time."""
    held: list[str] = []
    owners: list[int] = []
    size = 0
    for k, text in enumerate(texts):
        for p in passages(text) if text else ():
            held.append(p)
            owners.append(k)
            size += len(p)
            if size > CHARS:
                yield held, np.array(owners)
                held, owners, size = [], [], 0
    if held:
        yield held, np.array(owners)


def worst(texts: list[str | None], model: Model) -> tuple[np.ndarray, list[str | None]]:
    """The highest score of each text's passages and that passage; the base score and null without passages."""
    scores, which = np.full(len(texts), -np.inf), [None] * len(texts)
    for found, owners in in_blocks(texts):
        x, of = features(found, model.weights)
        if not len(x):
            continue
        raw = model.raw(x)
        order = np.lexsort((-of, raw))  # of equals, the first passage
        best = np.full(len(texts), -1)
        best[owners[of[order]]] = order
        for k in np.flatnonzero(best >= 0):
            if raw[best[k]] > scores[k]:
                scores[k], which[k] = raw[best[k]], found[of[best[k]]]
    return np.where(np.isinf(scores), model.base, scores), which


@dataclass
class Tree:
    """A binary tree in arrays; a leaf has feature -1."""

    feature: list[int]
    cut: list[float]
    left: list[int]
    right: list[int]
    value: list[float]

    def predict(self, columns: np.ndarray) -> np.ndarray:
        """The value for each row; columns: one row a feature, so that a cut compares numbers that lie side by side."""

        def of(k: int) -> np.ndarray | float:
            f = self.feature[k]
            return self.value[k] if f < 0 else np.where(columns[f] <= self.cut[k], of(self.left[k]), of(self.right[k]))

        return np.broadcast_to(of(0), columns.shape[1:])


def grow(x: np.ndarray, order: np.ndarray, gradient: np.ndarray, weight: np.ndarray, columns: np.ndarray, rising: np.ndarray, rows_in: np.ndarray) -> Tree:
    """The tree over some columns and rows that fits the gradients best, by second-order gain. order: the rows by each feature, one row a feature.

    A cut in a rising column must give the greater values the greater prediction.
    """
    tree = Tree([], [], [], [], [])
    n_features = len(columns)
    part = order[columns]
    up = np.isin(columns, rising)[:, None]

    def node(inside: np.ndarray, depth: int) -> int:
        k, m = len(tree.feature), int(inside.sum())
        g, h = gradient[inside].sum(), weight[inside].sum()
        for column, v in zip((tree.feature, tree.cut, tree.left, tree.right, tree.value), (-1, 0.0, -1, -1, g / (h + 1)), strict=True):
            column.append(v)
        if depth < DEPTH and m >= 2 * LEAST_LEAF:
            rows = part[inside[part]].reshape(n_features, m)
            v = x[rows, columns[:, None]]
            gs, hs = np.cumsum(gradient[rows], 1)[:, :-1], np.cumsum(weight[rows], 1)[:, :-1]
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            n = np.arange(1, m)
            gain[(v[:, 1:] <= v[:, :-1]) | (n < LEAST_LEAF) | (m - n < LEAST_LEAF) | (up & (gs / (hs + 1) > (g - gs) / (h - hs + 1)))] = -1
            f, at = np.unravel_index(int(np.argmax(gain)), gain.shape)
            if gain[f, at] > 1e-6:
                cut = float((v[f, at] + v[f, at + 1]) / 2)
                go = x[:, columns[f]] <= cut
                tree.feature[k], tree.cut[k] = int(columns[f]), cut
                tree.left[k], tree.right[k] = node(inside & go, depth + 1), node(inside & ~go, depth + 1)
        return k

    node(rows_in, 0)
    return tree


def boost(x: np.ndarray, y: np.ndarray, rising: list[int] | None = None) -> tuple[float, list[Tree]]:
    """Trees on a share of the columns and rows each, drawn by a fixed seed."""
    mean = float(np.clip(y.mean(), 0.01, 0.99))
    start = float(np.log(mean / (1 - mean)))
    score, trees = np.full(len(y), start), []
    order = np.argsort(x, 0, kind="stable").T
    across = np.ascontiguousarray(x.T)
    draw = np.random.default_rng(0)
    n = max(1, int(np.ceil(x.shape[1] * COLUMN_SHARE)))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        columns = np.sort(draw.choice(x.shape[1], n, replace=False))
        trees.append(grow(x, order, y - p, p * (1 - p), columns, np.array(rising or [], np.int64), draw.random(len(y)) < ROW_SHARE))
        score += RATE * trees[-1].predict(across)
    return start, trees


def summed_up(start: float, trees: list[Tree], x: np.ndarray) -> np.ndarray:
    across = np.ascontiguousarray(x.T)
    out = np.full(len(x), start)
    for t in trees:
        out += RATE * t.predict(across)
    return out


def isotonic(scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: scores and the rising probabilities at them."""
    order = np.argsort(scores, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(scores[order], y[order], strict=True):
        blocks.append([s, s, float(v), 1.0])
        while len(blocks) > 1 and (blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3] or blocks[-2][1] == blocks[-1][0]):
            _, high, total, n = blocks.pop()
            blocks[-1][1] = high
            blocks[-1][2] += total
            blocks[-1][3] += n
    xs = np.array([e for b in blocks for e in (b[0], b[1])])
    # a rule-of-succession estimate keeps probabilities away from 0 and 1
    return xs, np.array([(b[2] + 0.5) / (b[3] + 1) for b in blocks for _ in (0, 1)])


@dataclass
class Model:
    start: float
    trees: list[Tree]
    xs: np.ndarray
    ps: np.ndarray
    weights: Weights
    base: float
    held_out: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return summed_up(self.start, self.trees, x)

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, self.xs, self.ps)


def wordings(found: list[str], n: int = 3) -> np.ndarray:
    """A number for each passage, equal for passages that share n words in a row, directly or through others."""
    parent = list(range(len(found)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    seen: dict[tuple, int] = {}
    for k, p in enumerate(found):
        words = restored(folded(p)).replace(_MARK, " ").split()
        for at in range(max(1, len(words) - n + 1)):
            a, b = root(k), root(seen.setdefault(tuple(words[at : at + n]), k))
            parent[max(a, b)] = min(a, b)
    return np.array([root(k) for k in range(len(found))])


def folds_of(groups: np.ndarray, case: np.ndarray) -> np.ndarray:
    """A fold for each passage: groups stay together, the largest first into the fold with the fewest like it."""
    fold = np.zeros(len(groups), np.int64)
    size = np.zeros((FOLDS, 2))
    names, counts = np.unique(groups, return_counts=True)
    for g in names[np.argsort(-counts, kind="stable")]:
        inside = groups == g
        kind = int(case[inside].mean() >= 0.5)
        if not kind and inside.sum() > len(groups) / FOLDS:  # plain sentences that hang together by common words
            fold[inside] = np.arange(inside.sum()) % FOLDS
            continue
        k = int(np.argmin(size[:, kind]))
        fold[inside] = k
        size[k, kind] += inside.sum()
    return fold


def train(texts: list[str], labels: list[bool]) -> Model:
    """Trees on the passages of examples: of one with a category the passage that is most like a case, of the others all."""
    if len(set(labels)) < 2:
        raise ValueError("the examples must have a category 'none' and at least one other")
    found, owner = [], []
    for k, t in enumerate(texts):
        mine = passages(t) or [" "]
        if not labels[k]:  # parts of plain passages are plain as well: lines may hold a few words only
            mine += [" ".join(w[a:b]) for w in map(str.split, mine) if len(w) > 6 for a, b in ((0, 2), (len(w) // 2, len(w) // 2 + 3), (len(w) - 1, len(w)))]
        found += mine
        owner += [k] * len(mine)
    owner, case = np.array(owner), np.array(labels)[np.array(owner)]
    y = np.array(labels, float)
    x, of = features(found, Weights())
    sure = x[:, : len(HITS)].sum(1) + x[:, [COLUMNS.index(f"{a}_near_{b}") for a, b, _ in PAIRS if b != "about"]].sum(1)
    first, trees = 0.0, []
    trusted = np.ones(len(texts), bool)
    for _ in range(ROUNDS):
        best = np.full(len(texts), -1)
        order = np.argsort(sure, kind="stable")
        best[owner[of[order]]] = order  # each example's window that is most like a case
        chosen = np.zeros(len(x), bool)
        chosen[best[best >= 0]] = True
        used = np.flatnonzero((chosen | ~case[of]) & trusted[owner[of]])
        told = np.zeros(len(found), bool)
        told[of[best[(best >= 0) & (y > 0)]]] = True
        kept = np.flatnonzero((told | ~case) & trusted[owner])
        fold = np.zeros(len(found), np.int64)
        fold[kept] = folds_of(wordings([found[k] for k in kept]), told[kept])
        # an example's other passages go with the chosen one
        for k in np.flatnonzero((best >= 0) & (y > 0)):
            fold[owner == k] = fold[of[best[k]]]
        for k in range(FOLDS):
            rest = kept[fold[kept] != k]
            inside = np.flatnonzero(fold[of] == k)
            if len(inside):
                weights = weigh([found[p] for p in rest], told[rest])
                x[inside] = features(found, weights)[0][inside]
        target = told[of].astype(float)
        outside = np.zeros(len(x))
        for k in range(FOLDS):
            rest = used[fold[of[used]] != k]
            first, trees = boost(x[rest], target[rest], RISING)
            inside = fold[of] == k
            outside[inside] = summed_up(first, trees, x[inside])
        sure = outside
        text_score = np.full(len(texts), -np.inf)
        np.maximum.at(text_score, owner[of], outside)
        p = 1 / (1 + np.exp(-text_score))
        trusted = np.where(y > 0, p, 1 - p) >= WRONG
    scores = np.full(len(texts), -np.inf)
    np.maximum.at(scores, owner[of], outside)
    scores[np.isinf(scores)] = outside.min()
    xs, ps = isotonic(scores, y)
    first, trees = boost(x[used], target[used], RISING)
    weights = weigh([found[p] for p in kept], told[kept])
    model = Model(first, trees, xs, ps, weights, 0.0, float(((np.interp(scores, xs, ps) >= THRESHOLD) == (y > 0)).mean()))
    model.base = float(model.raw(np.zeros((1, x.shape[1]), np.float32))[0])
    return model


def fit(examples: DataFrame) -> Model:
    """The model of at most MOST_EXAMPLES labelled examples (text, category)."""
    rows = examples.where(F.col("text").isNotNull() & F.col("category").isNotNull()).select("text", "category").orderBy(F.xxhash64("text"), "category").limit(MOST_EXAMPLES).collect()
    return train([r["text"] for r in rows], [r["category"].strip().lower() != "none" for r in rows])


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, passage) of every document: the calibrated probability and the passage that gave it. Keeps source."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            raw, which = worst(batch.column("text").to_pylist(), m)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(m.probability(raw)), pa.array(which, pa.string()), batch.column("nameless")], ["doc_id", "source", "score", "passage", "nameless"])

    key = F.col("doc_id").cast("long")
    # rows without an id have a number instead, so that none of them is taken for another
    rows = documents.select(key.alias("doc_id"), "source", "text", F.when(key.isNull(), F.monotonically_increasing_id()).alias("nameless"))
    found = spread(rows).mapInArrow(score, "doc_id long, source string, score double, passage string, nameless long")
    return found.dropDuplicates(["doc_id", "nameless"]).drop("nameless")
