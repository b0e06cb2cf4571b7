"""A small labelled URL table (host, path, blocked), on which the query trains its model.

Names are made up from the words that hosts of a kind are known by, and none is taken from a test table. Blocked kinds are
gambling, adult, advert and tracking, spam and link farms, and pills; the others are ordinary hosts, among them many
that hold a word of a blocked kind inside another one (roads, pillow, alphabet, essex, farms). Each name stands
under several prefixes and domains, the same for both verdicts, so that neither a domain nor a language in the path tells
anything by itself; an empty host is ordinary. Blocked paths on ordinary hosts are the second part.
"""

from __future__ import annotations

import random

BLOCKED = {
    "gambling": "casino casino-royal mega-casino casino-slots live-casino casinobonus vip-casinos lucky-casino bet bets bet-now sport-bets bets-online betting bestbets betwin bet-win win-big big-win winbet "
    "jackpot jackpot-city poker poker-room pokerstar slots free-slots slotmachine free-spins roulette blackjack gamble gambling-den lotto-win bingo-win bookmaker free-poker bets24 freebet-club",
    "adult": "adult adult-cams adult-video adults-only adultdating adult-24 my-adult adult-zone xxx xxx-tube xxxvideos porn pornhouse free-porn porno-live sex sex-chat sexcams hot-sex livesex nude-girls nudes "
    "escort escorts-city erotic erotica-shop camgirls hentai milf-tube fetish-x adult-xx x-rated",
    "advert": "ads ads-server adserver ad-server ads-net ads-click click-ads adsnetwork my-ads ads-media adtrack ad-track adtracker tracker ads-tracker track-click click-tracker clicktrack trackpixel pixel-track "
    "track-user banner-ads bannerads popads pop-ads popunder adclick doubleads adsyndicate ad-exchange telemetry-track metrics-track track-ads",
    "spam": "spam spammer spam-links spam-mail spam-seo spamhost link-farm linkfarm links-farm content-farm seo-farm spam-net click-farm spam-world get-rich get-rich-quick free-money easy-money quick-cash make-money "
    "free-prizes free-gifts free-iphone you-win-prize prize-winner miracle-diet replica-watches cheap-replica cheap-backlinks buy-backlinks cheap-followers cheap-loans payday-loans free-ringtones",
    "pills": "pills pills-online buy-pills diet-pills pillstore pill-shop best-pills cheap-meds cheap-viagra viagra viagra-pills cialis buy-cialis cheap-pharma no-prescription-pills rx-pills xanax-pills pharma-pills pills4u cheappillz",
}
ORDINARY = (
    "roads broadstreet beads-and-yarn downloads threads-weekly uploads headstart leads-theatre crossroads railroads pads-repair "
    "pillow-shop caterpillar pillar-press spillway alphabet betterhomes betty-cooks between-lines diabetes-care tibet-travel elizabeth-school bethany abetone "
    "windows-help winter-sports wine-cellar window-garden winston-library darwin-museum godwin-books twin-cities swindon-news "
    "athletics-track race-track soundtrack-archive track-and-field trackwork railway-track tracks-magazine adult-education adult-learning adult-literacy young-adult-fiction adulthood-studies "
    "essex-county sussex-news middlesex-hospital wessex-trains sexton-archive sunny-farm farm-equipment dairy-farm family-farms farmers-market hill-farm windfarm-info cheap-flights cheap-recipes cheapside-history "
    "free-software free-library freedom-press free-range-cooking freeways spamalot-musical slotted-joints exchange-rates clickwork picks-and-reviews moneta-museum bingley-town pokemon-wiki "
    "news daily-news morning-post herald gazette tribune city-journal world-report weather forecast science physics-today chemistry biology-lab mathematics astronomy geology history-archive museum gallery library "
    "university college school-board academy faculty research institute laboratory hospital clinic health-care dentist pharmacy-board nursing kitchen recipes cooking bakery garden flowers travel hotel-guide camping hiking "
    "mountain-club river-trust lake-district ocean-watch forest-service wildlife birds fishing sailing cycling football rugby tennis cricket swimming running chess music orchestra theatre cinema film-review photography painting "
    "architecture engineering software programming python-docs linux-forum database hardware electronics robotics network-admin security-notes cloud-guide blog-of-anna thoughts notes diary stories poetry novels bookshop publisher "
    "parliament government ministry city-council court law-review police-notice fire-service postoffice tax-office statistics census bank insurance economics finance-times accounting market-report trade-union industry "
    "car-review motor-club bicycle-repair trains airport harbour bus-timetable church parish cathedral mosque synagogue monastery charity volunteers youth-club family children toys puzzles crafts knitting sewing pottery "
    "cats dogs horses veterinary zoo aquarium farming-weekly tractors weather-station energy solar-panels windmill electric water-board recycling climate environment national-park heritage castle genealogy ancestors maps atlas "
    "dictionary encyclopedia translation grammar language-school zeitung nachrichten rathaus verein bibliothek universitaet mairie journal-officiel bibliotheque cuisine universite noticias biblioteca ayuntamiento universidad cocina "
)
PREFIXES = ("", "www.", "m.", "blog.", "shop.", "en.")
DOMAINS = (".com", ".example.com", ".org", ".example.org", ".net", ".example.net", ".info", ".de", ".fr", ".es", ".co.uk", ".io")
PATHS = ("", "/", "/en/{}", "/de/{}/", "/fr/{}.html", "/es/{}", "/en/{}/", "/de/{}", "/fr/{}", "/es/{}.html", "/index.html", "/about", "/{}/page", "/en/{}.html", "/news/{}", "/article/{}")
BLOCKED_PATHS = (
    "/casino/{}", "/casino/bonus", "/bets/{}", "/betting/live", "/poker/{}", "/free-spins/{}", "/slots/{}", "/jackpot", "/xxx/{}", "/porn/{}", "/adult/{}", "/sex/video", "/nude/{}",
    "/ads/click/{}", "/adserver/{}", "/banner/ads/{}", "/ad/track/{}", "/popunder/{}", "/buy-viagra", "/cheap-pills/{}", "/pills/{}", "/cialis/{}", "/free-money", "/get-rich/{}", "/spam/{}",
)
#: Of each name so many URLs.
EACH = 4
#: So many ordinary names of syllables without a meaning, as most hosts bear a name that no list of words holds.
BRANDS = 400
ONSETS, VOWELS, CODAS = "b br c ch cl d dr f fl g gr h j k l m n p pr qu r s sh st t th tr v w z".split(), "a e i o u ea ou ai".split(), ["", "", "n", "r", "s", "t", "l", "nd", "th", "st", "b", "ng"]


def _brands() -> list[str]:
    draw = random.Random(7).random
    pick = lambda parts: parts[int(draw() * len(parts))]
    return ["".join(pick(ONSETS) + pick(VOWELS) + pick(CODAS) for _ in range(2 + k % 2)) for k in range(BRANDS)]


def labelled_urls() -> list[tuple[str, str, bool]]:
    """The rows of the table, always the same."""
    blocked, ordinary = sorted({name for kind in BLOCKED.values() for name in kind.split()}), sorted({*ORDINARY.split(), *_brands()})
    rows = [("", "", False)]
    for names, verdict in ((blocked, True), (ordinary, False)):
        for k, name in enumerate(names):
            for j in range(EACH):
                n = k * EACH + j
                rows.append((PREFIXES[n % 6] + name + DOMAINS[(n + n // 12) % 12], PATHS[(n * 5 + n // 16) % 16].format(n * 37 % 9973), verdict))
    for k, path in enumerate(BLOCKED_PATHS):
        for j in range(EACH):
            n = k * EACH + j
            rows.append((PREFIXES[n % 6] + ordinary[n * 3 % len(ordinary)] + DOMAINS[(n + n // 12) % 12], path.format(n * 37 % 9973), True))
    return rows
