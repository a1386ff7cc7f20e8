"""Word lists and patterns of the lexical rules, in natural order."""

#: Words without content.  Negations and words of change are not among them, as they alter the meaning.
STOPWORDS = sorted(set("""
a al algo algun alguna algunas alguno algunos ante antes aqui asi aun aunque bajo bien cada
como con contra cual cuales cuando de del desde donde dos e el ella ellas ello ellos en entre
era eran es esa esas ese eso esos esta estaba estaban estan estar este esto estos fue fueron
ha habia han hasta hay la las le les lo los mas me mi mientras muy nos o otra otras otro otros
para pero poco por porque que quien quienes se segun ser si sido sobre su sus tambien tan tanto
te tiene tienen todo todos tras tu un una unas uno unos y ya yo e u vs ante cual hoy ayer
cómo qué cuál quién dónde cuándo será serán sería puede pueden podría fue tras sus les esto
""".split()))

NEGATIONS = ["no", "ni", "nunca", "jamas", "tampoco", "sin", "nadie", "ningun", "ninguna", "ninguno", "nada"]

#: Something stopped, in lower case without accents.
CESSATION = r"\bdej(?:o|a|an|aron|ara|aria|aran)\s+de\b|\bya no\b|\bfren(?:o|a|an|aron)\b|\bces(?:o|a|an|aron)\b|\binterrump(?:e|en|io|ieron)\b"

DATE_WORDS = """
lunes martes miercoles jueves viernes sabado domingo enero febrero marzo abril mayo junio julio
agosto septiembre setiembre octubre noviembre diciembre hoy ayer manana semana mes ano
""".split()

BOILERPLATE = [
    "en vivo", "minuto a minuto", "ultimas noticias", "lo que hay que saber", "que paso", "uno por uno", "paso a paso", "de hoy", "hoy domingo", "hoy lunes", "hoy martes", "hoy miercoles", "hoy jueves",
    "hoy viernes", "hoy sabado", "todo lo que", "que se sabe", "cuales son", "que es", "como es", "a que hora", "donde ver", "primera vez en la historia", "en las ultimas horas", "que hay que saber",
    "lo que se sabe", "en el marco de", "a traves de", "en medio de", "de acuerdo con", "quien gana hoy",
]

ENTITY_STOP = """
El La Los Las Un Una En Con Por Para Qué Cómo Cuál Quién Dónde Cuándo Así Tras Ante Según Hoy Ayer Este Esta
EN VIVO Además Mientras Desde Sin No Ya Del Al Lo Se Ejemplo Video Fotos Galería Opinión Análisis Exclusivo
Le Les Su Sus Mi Me Nos Te Es Son Fue Era Hay Estoy Está Están Somos Vamos Mañana Crisis
""".split()

WORD = r"\d+(?:[.,]\d+)*%?|\p{L}+(?:[-']\p{L}+)*"
NUMBER = r"(?i)(?:US\$|u\$s|\$|€)?\s?\d+(?:[.,]\d+)*\s?(?:%|por ciento|millones|mil millones|billones|puntos|pp)?"
QUOTE = r"[\"“«‘']([^\"”»’']{8,200})[\"”»’']"
_UPPER, _LOWER = "A-ZÁÉÍÓÚÑÜÃÕÂÊÔÀÈÌÒÙÇÄËÏÖ", "a-záéíóúñüãõâêôàèìòùçäëïö"
ENTITY = rf"(?<![\p{{L}}\d_])([{_UPPER}][{_LOWER}]+(?:\s+(?:de|del|da|do|dos|la|las|los|y)?\s*[{_UPPER}][{_LOWER}]+)*|[{_UPPER}]{{2,8}}(?:\d+)?)(?![\p{{L}}\d_])"

#: Query parameters that only track; those that begin with utm_ do too.
TRACKING = ["fbclid", "gclid", "dclid", "gbraid", "wbraid", "msclkid", "yclid", "igshid", "twclid", "mc_cid", "mc_eid", "_ga", "_gl", "ocid", "cmpid", "s_cid", "__twitter_impression"]

#: Kinds of relation that are worth a language model's look.
CANDIDATE_TYPES = ["mismo_hecho", "expresion_compartida", "titular_casi_identico", "afirmaciones_distintas"]

#: What reveals a common source, in lower case without accents; the first pattern that is found counts.
COMMON_SOURCES = {
    "informe": [r"\binforme\b", r"\brelevamiento\b", r"\bencuesta\b", r"\bestudio\b", r"\breporte\b", r"\bsegun datos de\b", r"\bdatos del indec\b", r"\bindec\b", r"\bindice\b", r"\bboletin oficial\b"],
    "conferencia": [r"\bconferencia de prensa\b", r"\bconferencia\b", r"\bcadena nacional\b", r"\bcomunicado\b", r"\bdiscurso\b", r"\banuncio oficial\b", r"\bvocero\b"],
    "agencia": [r"\(na\)", r"\bnoticias argentinas\b", r"\bagencia\b", r"\befe\b", r"\bafp\b", r"\breuters\b", r"\btelam\b", r"\beuropa press\b", r"\bbloomberg\b"],
    "entrevista": [r"\ben (?:una )?entrevista con\b", r"\bentrevistado por\b", r"\ben dialogo con\b", r"\ben declaraciones a\b", r"\bdijo a\b", r"\ben una charla con\b"],
}

#: Events of a reader that are recorded.
EVENTS = ["impresion", "detalle", "original", "ocultar"]

#: What a summary must not say, in lower case without accents, and why.
NOT_IN_SUMMARY = [
    (r"\boriginad?[oaó]s?\b|\borigin(o|aron|a|an)\b", "atribuye el origen de una información"),
    (r"\bcopi(o|aron|a|an|ado|ada|ados|adas)\b", "habla de copia entre medios"),
    (r"\bcoordin", "sugiere coordinación"),
    (r"\bdirig(e|en|io|ieron)\b", "dice que un medio dirige a otro"),
    (r"\bmarc(o|aron|a|an) (la |el )?(agenda|tema|ritmo)", "dice que alguien marcó la agenda"),
    (r"\b(instal|impuls)(o|aron|a|an) (el|la|los|las|un|una) (tema|agenda|discurso|relato)", "atribuye la instalación de un tema"),
    (r"\bcampana\b|\boperacion (mediatica|de prensa)\b", "sugiere una campaña"),
    (r"\bsesg", "atribuye sesgo"),
    (r"\b(verdader[oa]s?|fals[oa]s?|mintio|miente|mienten|fake)\b", "juzga la verdad"),
    (r"\blinea editorial\b", "atribuye línea editorial"),
]
