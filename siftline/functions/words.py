"""Word lists that fix the results of the text operators."""

from __future__ import annotations

# Stop words.
STOPWORDS_EN = frozenset("""
a an the and or but if then than so for with without of to in on at by from up down out off over under again further
once here there when where why how all any both each few more most other some such only own same too very can will
just should now is are was were be been being have has had having do does did doing you your yours yourself we our
ours they their theirs them this that these those it its as about into through during before after above below
between not no nor
""".split())

# Spanish stop words.
STOPWORDS_ES = frozenset("""
el la los las un una unos unas de del al y o u pero si no que quien quienes para por con sin sobre entre hacia hasta
desde durante mediante segun según ante bajo tras en es son fue fueron ser estar esta está estas están esto eso aquello
este esa ese aquel aquella mi tu su sus nuestro nuestra nuestros nuestras yo tu2 el2 ella nosotros ustedes ellos ellas
lo le les se muy mas más menos todo toda todos todas otro otra otros otras cada algun algún alguna algunos algunas
ningun ningún ninguna solo sólo asi así tambien también cuando donde dónde como cómo porque
""".split()) | {"por qué"}

# Short technical terms that are never stop words.
NEVER_STOPPED = frozenset("r go c js ts ci cd ai ml nlp qa ui ux os io vr ar db api sql aws gcp sre dry kiss xp".split())

STOPWORDS = (STOPWORDS_EN | STOPWORDS_ES) - NEVER_STOPPED

# Words of job offers that name no subject.
GENERIC_WORDS = frozenset("""
experiencia conocimiento conocimientos manejo nivel años año ingles inglés titulo título estudios carrera universidad
deseable excluyente requerido requerida requisito requisitos obligatorio trabajo laboral perfil puesto cargo empresa
idioma idiomas modalidad jornada horario salario sueldo beneficios búsqueda busqueda candidato candidatos
disponibilidad remoto remota híbrido hibrido hibrida híbrida presencial senior junior semi mid sr jr ssr
experience years year knowledge level english spanish degree required requirement requirements candidate candidates
job work role position company skills skill bachelor master university desired preferred must need needed remote
hybrid onsite salary benefits language languages availability
""".split())

# Synonyms; a term expands to its synonyms, and term and synonyms match each other.
SYNONYMS = {
    "postgres": ["postgresql"],
    "k8s": ["kubernetes"],
    "gh actions": ["github actions"],
    "js": ["javascript"],
    "ts": ["typescript"],
    "py": ["python"],
    "tf": ["tensorflow"],
    "terraform": ["infrastructure as code", "iac"],
    "aws": ["amazon web services"],
    "gcp": ["google cloud platform"],
    "azure": ["microsoft azure"],
    "ci/cd": ["continuous integration", "continuous delivery", "continuous deployment"],
    "rest": ["restful"],
    "api": ["apis"],
    "db": ["database"],
    "ml": ["machine learning"],
    "ai": ["artificial intelligence"],
    "nlp": ["natural language processing"],
    "cv": ["computer vision"],
    "oop": ["object oriented programming"],
    "fp": ["functional programming"],
    "sql": ["structured query language"],
    "nosql": ["mongodb", "cassandra", "dynamodb", "couchdb"],
    "agile": ["scrum", "kanban"],
    "devops": ["sre", "site reliability engineering"],
}

# Phrases that exclude what their sentence names.
NEGATIONS = (
    r"no\s+se\s+requiere",
    r"no\s+se\s+requieren",
    r"no\s+se\s+necesita",
    r"no\s+se\s+necesitan",
    r"no\s+es\s+necesario",
    r"no\s+es\s+requisito",
    r"no\s+es\s+excluyente",
    r"no\s+buscamos|no\s+estamos\s+buscando",
    r"no\s+se\s+valora|no\s+se\s+valoran",
    r"excluyente\s*:\s*no",
    r"not\s+required|is\s+not\s+required|not\s+a\s+requirement",
    r"not\s+necessary|not\s+needed",
    r"no\s+experience(?:\s+in|\s+with|\s+of)?",
    r"not\s+looking\s+for",
    r"no\s+need\s+(?:for|to)?",
)

# A word of a negated sentence, the marks that make a term a pattern on raw text, and letters of a reason's words.
NEGATED_WORD = r"(?U)([a-zA-ZáéíóúñüÁÉÍÓÚÑÜ][\w+#.\-]*)"
SEPARATORS = "+#.-/"
REASON_WORD = r"(?U)\b[a-záéíóúñü]{3,}\b"

# Words of offers that explain no match.
FILLER = frozenset("""
use using used work working worked experience experienced years year least plus good strong excellent solid deep
proven track record ability able looking seeking join team company role position job
""".split())

# Headings that open a requirements section, lines that end it, and marks that cut a text without one.
REQUIREMENT_HEADS = ("Requisitos", "Requirements", "Qualifications", "What you need", "Must have", "Responsabilidades", "Responsibilities", "Perfil buscado", "Lo que buscamos", "Buscamos")
REQUIREMENT_ENDS = (
    "Ofrecemos", "Ofreceremos", "Beneficios", "Qué ofrecemos", "Que ofrecemos", "What we offer", "Nice to have", "Deseable", "About us", "About the company", "Quiénes somos", "Sobre nosotros", "Apply now", "Postulate",
    "Postúlate", "Postulate ya", "Aplicá", "Aplica", "Cómo postularme", "Como postularme", "Cómo aplicar", "Salario", "Remuneración", "Remuneracion", "Compensación", "Compensacion",
)
OPTIONAL_MARKS = ("Nice to have", "Deseable", "Plus", "Preferred")

# Marks cut off both ends of a token before dictionary look-up.
TOKEN_EDGES = ".,;:!?()[]{}<>\"'¡¿…"


def variants(term: str) -> list[str]:
    """The term and all terms that count as the same, sorted."""
    low = term.lower().strip()
    group = {low}
    for key, others in SYNONYMS.items():
        if low == key or low in others:
            group = {key, *others}  # of several groups the last one listed holds
    return sorted(group)
