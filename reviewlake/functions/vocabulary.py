"""Word lists used by the aspect and polarity rules."""

from __future__ import annotations

from dataclasses import dataclass, field

# --- Fixed values: aspect keywords by language, in their published order -----------------------
ASPECT_KEYWORDS: dict[str, dict[str, list[str]]] = {
    "quality": {
        "en": ["quality", "material", "build", "construction", "durable", "sturdy", "solid", "well made",
               "poorly made", "cheap", "flimsy"],
        "es": ["calidad", "material", "construccion", "duradero", "solido", "resistente", "bien hecho",
               "mal hecho", "barato", "fragil"],
        "pt": ["qualidade", "material", "construcao", "duravel", "solido", "resistente", "bem feito",
               "mal feito", "barato", "fragil"],
    },
    "price": {
        "en": ["price", "cost", "value", "money", "expensive", "cheap", "affordable", "worth", "overpriced",
               "bargain"],
        "es": ["precio", "costo", "valor", "dinero", "caro", "barato", "economico", "vale", "sobreprecio",
               "ganga"],
        "pt": ["preco", "custo", "valor", "dinheiro", "caro", "barato", "economico", "vale", "sobrepreco",
               "pechincha"],
    },
    "shipping": {
        "en": ["shipping", "delivery", "arrived", "package", "packaging", "box", "fast", "slow", "damaged",
               "tracking"],
        "es": ["envio", "entrega", "llego", "paquete", "empaque", "caja", "rapido", "lento", "danado",
               "seguimiento"],
        "pt": ["envio", "entrega", "chegou", "pacote", "embalagem", "caixa", "rapido", "lento", "danificado",
               "rastreamento"],
    },
    "service": {
        "en": ["service", "customer", "support", "seller", "response", "help", "communication", "return",
               "refund"],
        "es": ["servicio", "cliente", "soporte", "vendedor", "respuesta", "ayuda", "comunicacion",
               "devolucion", "reembolso"],
        "pt": ["servico", "cliente", "suporte", "vendedor", "resposta", "ajuda", "comunicacao", "devolucao",
               "reembolso"],
    },
    "functionality": {
        "en": ["works", "function", "performance", "broken", "defective", "issue", "problem", "feature",
               "useless", "useful"],
        "es": ["funciona", "funcion", "rendimiento", "roto", "defectuoso", "problema", "caracteristica",
               "inutil", "util"],
        "pt": ["funciona", "funcao", "desempenho", "quebrado", "defeituoso", "problema", "recurso", "inutil",
               "util"],
    },
    "appearance": {
        "en": ["look", "color", "size", "design", "style", "beautiful", "ugly", "photo", "picture",
               "different"],
        "es": ["aspecto", "color", "tamano", "diseno", "estilo", "bonito", "feo", "foto", "imagen",
               "diferente"],
        "pt": ["aparencia", "cor", "tamanho", "design", "estilo", "bonito", "feio", "foto", "imagem",
               "diferente"],
    },
    "product": {
        "en": ["product", "item", "article", "purchase", "buy", "order", "recommend"],
        "es": ["producto", "articulo", "compra", "comprar", "pedido", "recomendar"],
        "pt": ["produto", "artigo", "compra", "comprar", "pedido", "recomendar"],
    },
}

# --- Fixed values: polarity words by language, in their published order ------------------------
POLARITY_WORDS: dict[str, dict[str, list[str]]] = {
    "positive": {
        "en": ["good", "great", "excellent", "amazing", "love", "best", "perfect", "awesome", "fantastic",
               "wonderful", "happy", "satisfied", "recommend", "fast", "beautiful"],
        "es": ["bueno", "excelente", "increible", "amor", "mejor", "perfecto", "genial", "fantastico",
               "maravilloso", "feliz", "satisfecho", "recomiendo", "rapido", "bonito", "encantado"],
        "pt": ["bom", "excelente", "incrivel", "amor", "melhor", "perfeito", "otimo", "fantastico",
               "maravilhoso", "feliz", "satisfeito", "recomendo", "rapido", "bonito", "encantado"],
    },
    "negative": {
        "en": ["bad", "terrible", "awful", "horrible", "worst", "hate", "broken", "defective", "slow", "poor",
               "disappointed", "waste", "useless", "damaged", "wrong"],
        "es": ["malo", "terrible", "horrible", "peor", "odio", "roto", "defectuoso", "lento", "pobre",
               "decepcionado", "desperdicio", "inutil", "danado", "incorrecto", "pesimo"],
        "pt": ["mau", "terrivel", "horrivel", "pior", "odio", "quebrado", "defeituoso", "lento", "pobre",
               "decepcionado", "desperdicio", "inutil", "danificado", "errado", "pessimo"],
    },
}

# --- Fixed values: substrings counted by the keyword heuristic ---------------------------------
HEURISTIC_WORDS: dict[str, dict[str, list[str]]] = {
    "es": {
        "positive": ["bueno", "excelente", "recomiendo", "genial", "perfecto", "encanta"],
        "negative": ["malo", "terrible", "horrible", "pesimo", "no recomiendo", "decepcion"],
    },
    "pt": {
        "positive": ["bom", "excelente", "recomendo", "otimo", "perfeito", "adorei"],
        "negative": ["ruim", "terrivel", "horrivel", "pessimo", "nao recomendo", "decepcionado"],
    },
    "other": {
        "positive": ["good", "great", "excellent", "recommend", "love", "amazing"],
        "negative": ["bad", "terrible", "horrible", "awful", "hate", "worst"],
    },
}

# --- Fixed values: English contractions, expanded in this order --------------------------------
CONTRACTIONS: list[tuple[str, str]] = [
    ("n't", " not"), ("'re", " are"), ("'s", " is"), ("'d", " would"), ("'ll", " will"), ("'ve", " have"),
    ("'m", " am"),
]


@dataclass(frozen=True)
class Lexicon:
    """Polarity words with the languages merged."""

    positive: frozenset[str]
    negative: frozenset[str]

    @staticmethod
    def of(by_label: dict[str, dict[str, list[str]]]) -> "Lexicon":
        merged = {label: frozenset(w for ws in langs.values() for w in ws) for label, langs in by_label.items()}
        return Lexicon(merged.get("positive", frozenset()), merged.get("negative", frozenset()))

    @property
    def words(self) -> list[str]:
        return sorted(self.positive | self.negative)


@dataclass(frozen=True)
class Taxonomy:
    """Aspect -> keywords with the languages merged and lower-cased; aspect order is kept."""

    keywords: dict[str, frozenset[str]] = field(default_factory=dict)

    @staticmethod
    def of(by_aspect: dict[str, dict[str, list[str]]]) -> "Taxonomy":
        return Taxonomy({
            aspect: frozenset(w.lower() for ws in langs.values() for w in ws) for aspect, langs in by_aspect.items()
        })

    @property
    def aspects(self) -> list[str]:
        return list(self.keywords)

    def words(self, aspect: str) -> list[str]:
        return sorted(k for k in self.keywords[aspect] if " " not in k)

    def phrases(self, aspect: str) -> list[str]:
        return sorted(k for k in self.keywords[aspect] if " " in k)

    @property
    def all_words(self) -> list[str]:
        return sorted({k for ks in self.keywords.values() for k in ks if " " not in k})

    @property
    def all_phrases(self) -> list[str]:
        return sorted({p for a in self.aspects for p in self.phrases(a)})


DEFAULT_TAXONOMY = Taxonomy.of(ASPECT_KEYWORDS)
DEFAULT_LEXICON = Lexicon.of(POLARITY_WORDS)
