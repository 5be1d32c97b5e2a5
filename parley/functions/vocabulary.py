"""Word lists, patterns and bounds that results depend on. They are data, not logic."""

from __future__ import annotations

#: Words that mark a request's language.
REQUEST_PT = """quero queria viagem praia montanha barato até ate com para uma um não nao sim minha meu gostaria familia família noite noites dias
lugar melhor mais também tambem orçamento orcamento preciso pode você voce falar inglês ingles português portugues e quem qual quais quando
onde porque porquê como é são foi era está estao estou tem tenho faz fazer vou vai eu nós nos eles elas ele ela isso esse essa do da dos das
em no na por sobre conte saber favor olá ola oi obrigado obrigada bom boa tudo bem conhece significa capital tempo clima notícia noticia
história historia piada""".split()
REQUEST_EN = """want would like trip beach mountain cheap under with for the my family night nights days place best more also budget need can you
speak english portuguese and a an to who what when where why how is are was were do does did could should will i me we they he she it this
that of in on at about tell know please hello hi thanks thank good bad yes no capital weather news story joke mean""".split()
#: Letters that tell Portuguese at once.
REQUEST_MARKS = "[ãõçáéíóúâêôà]"
#: Names of languages, and their codes.
PT_NAMES = ["pt", "pt-br", "ptbr", "portuguese", "português", "portugues", "brazilian portuguese"]
EN_NAMES = ["en", "en-us", "en-gb", "english"]
#: An explicit wish for a language: a verb, at most 28 characters of the same sentence, a language.
SWITCH = "(?:speak|switch|change|talk|reply|respond|continue|use|falar|trocar|mudar|continuar|responder|usar)[^.!?]{0,28}?(english|ingles|portuguese|portugues)"

#: Words that answers of either language hold, for the margin test.
ANSWER_PT = """que não nao você voce uma com para isso está esta muito bem também tambem então entao eu acho aqui tudo mas por sobre quando
obrigado obrigada sim ser são sao foi tem vai pode como mais de da do em um se os as ao dos das pelo pela aquilo essa esse este nosso nossa
meu minha seu sua estou estava quero preciso gosto vamos entendi legal certo beleza opções opcoes ninguém alguém porque porquê qual quais
onde quanto quantos nada sempre nunca talvez depois antes agora hoje aí ai né""".split()
ANSWER_EN = """the you your and that this with have are was were what when where which how can could would should will there their them they
it its is of to in for on as at be been do does did not but or if so from about like just some any more most very also than then because
into over after before well yeah okay sure right""".split()
#: Stop words that a text is held against before it counts as Portuguese; of these lists only words without marks can be met.
STOP_PT = """de a o que e do da em um para com uma os no se na por mais as dos como mas foi ao ele das tem seu sua ou ser quando muito nos eu
pra a gente meu minha esse essa isso isto este esta aquilo aquela onde como porque sobre entre depois antes durante mesmo cada outro outra
pouco muito menos mais ainda assim aqui ali agora ontem hoje sempre nunca alguem todos todas tudo nada algo qualquer deve pode deveria
poderia quer quero vamos vou ir fazer feito diz disse falar falou gosto gosta acho acha sei sabe viu olha espera calma obrigado obrigada
por favor desculpa""".split()
STOP_EN = """the a an and or but of to in for on with from by at as is are was were be been being have has had do does did will would can
could should shall may might must i you he she it we they him her its our your their this that these those what which who whom whose when
where why how not no yes so if then than because about into over under again further once here there all any both each few more most other
some such only own same too very just also get got make made way people know knew think thought say said speak spoke""".split()

#: What a request's words say of a trip.
TAGS = {
    "beach": "beach, praia, seaside, litoral, coast, costa, sand, areia",
    "islands": "island, ilha, ilhas, islands, arquipelago",
    "mountains": "mountain, montanha, serra, alps, alpes, hill, colina",
    "city": "city, cidade, urban, urbano, metropolis, metropole",
    "culture": "culture, cultura, museum, museu, art, arte, theatre, teatro",
    "food": "food, comida, gastronomy, gastronomia, restaurant, restaurante, culinary, culinaria",
    "nightlife": "nightlife, balada, festa, party, night out, vida noturna",
    "nature": "nature, natureza, wildlife, vida selvagem, forest, floresta",
    "family": "family, familia, kids, criancas, children, child, crianca",
    "romantic": "romantic, romantico, romantica, honeymoon, lua de mel, couple, casal",
    "adventure": "adventure, aventura, hiking, trilha, trekking, adrenaline, adrenalina",
    "budget": "cheap, barato, budget, economico, affordable, value, custo-beneficio",
    "luxury": "luxury, luxo, premium, 5 star, cinco estrelas, high end, expensive, caro, sofisticado",
    "history": "history, historia, historic, historico, heritage, patrimonio",
    "wildlife": "wildlife, vida selvagem, animals, animais, safari",
    "diving": "diving, mergulho, snorkel, snorkeling, scuba",
    "hiking": "hiking, trilha, trekking, trail",
    "skiing": "ski, esqui, snowboard, snow, neve",
    "wine": "wine, vinho, vinicola, winery, vineyard",
    "theme_parks": "theme park, parque tematico, disney, universal, roller coaster",
    "shopping": "shopping, compras, outlet, mall, shopping center",
    "music": "music, musica, samba, tango, concert, concerto",
}
PLACES = {
    "south_america": "south america, america do sul, brasil, brazil, argentina, chile, peru",
    "north_america": "north america, america do norte, mexico, canada, usa, united states, estados unidos",
    "europe": "europe, europa, portugal, greece, grecia, spain, espanha, italy, italia",
    "asia": "asia, japan, japao, thailand, tailandia, china",
    "africa": "africa, south africa, africa do sul, morocco, marrocos",
}
CLIMATES = {"warm": "warm, quente, calor, sunny, sol", "cold": "cold, frio, snow, neve, winter, inverno", "mild": "mild, ameno, spring, primavera"}
PACES = {"relaxed": "relaxed, tranquil, tranquilo, slow, devagar", "adventure": "adventure, aventura, active, ativo, hiking"}
RESETS = """start over, reset, show all, clear filters, anywhere, surprise me, show me everything, everything again, all trips, show everything,
comecar de novo, limpar filtros, mostrar tudo, mostrar tudo de novo, tudo de novo, todas as viagens, qualquer lugar, me surpreenda, tanto faz, reiniciar"""
ALSO = "also, as well, too, tambem, e tambem"
NOT_DEAR = "not too expensive, not expensive, nao muito caro, nao caro"
MODERATE = "not too expensive, nao muito caro"
CHEAPER = "cheaper, more affordable, mais barato, menos caro"
ANY_PRICE = "no budget, forget the budget, any budget, any price, money is no object, sem orcamento, sem limite, qualquer preco, esqueca o orcamento"

#: Bounds of prices and nights, the prices that words stand for, and what cheaper takes.
LEAST_PRICE, MOST_PRICE, MOST_NIGHTS = 300, 12000, 30
BUDGET_PRICE, MODERATE_PRICE, CHEAPER_SHARE = 1200, 1500, 0.85
#: Words before an amount; a currency's signs and words; numbers in words.
BEFORE_AMOUNT = "under|below|less than|up to|max(?:imum)?|budget(?: of)?|around|about|for|ate|até|abaixo de|menos de|no maximo|no máximo|por|com|aproximadamente|cerca de"
SIGNS, CURRENCIES = r"us\$|r\$|\$", "dollars?|dolares?|reais|usd"
HUNDREDS_EN = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen".split()
HUNDREDS_PT = {"cem": 100, "cento": 100, "duzentos": 200, "trezentos": 300, "quatrocentos": 400, "quinhentos": 500, "seiscentos": 600, "setecentos": 700, "oitocentos": 800, "novecentos": 900}
THOUSANDS_PT = {"dois": 2, "tres": 3, "quatro": 4, "cinco": 5, "seis": 6, "sete": 7, "oito": 8, "nove": 9, "dez": 10}
A_WEEK = "a week|one week|uma semana|1 semana|7 nights|7 noites"

#: Words that make a turn a request for a trip, that name one outright, and that ask for something else.
HINTS = """trips?|travel|vacations?|holidays?|itinerary|hotels?|flights?|destinations?|recommend|suggests?|suggestions?|options?|booking|book|beaches?|mountains?|islands?|
viagens?|viajar|ferias|roteiros?|hoteis|voos?|destinos?|recomend|sugest|sugestoes|opcoes|reservar|praias?|montanhas?|ilhas?""".replace("\n", "")
OUTRIGHT = "trips?|travel|vacations?|holidays?|itinerary|hotels?|flights?|destinations?|booking|book|viagens?|viajar|ferias|roteiros?|hoteis|voos?|destinos?|reservar"
GENERAL = """joke|piada|story|historia|anecdote|who is|who was|quem e|quem foi|what is the capital|capital of|qual e a capital|weather|forecast|clima|tempo em|news|noticia|
how are you|como voce esta|how do you|como funciona|why is|why do|por que|porque""".replace("\n", "")
TOPICS = """movie|film|music|song|recipe|poem|actor|actress|singer|musician|athlete|driver|president|capital|science|math|history of|weather|news|game|sport|team|computer|python|code|
filme|livro|musica|receita|poema|ator|atriz|cantor|atleta|piloto|presidente|ciencia|historia de|jogo|esporte|time|computador|codigo""".replace("\n", "")


def listed(text: str) -> list[str]:
    return [w.strip() for w in text.replace("\n", " ").split(",")]


def any_of(words: str) -> str:
    """A pattern that finds one of the words, whole."""
    return rf"\b({'|'.join(listed(words))})\b"


def mention(words: str) -> str:
    """A pattern that finds one of the words, whole, or its simple plural."""
    return rf"\b({'|'.join(listed(words))})(s|es)?\b"
