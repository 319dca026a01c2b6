"""A small labelled table of urls (host and path), written for this library."""

# Ordinary sites, articles, shops, documentation, language paths.
ALLOWED = (
    "www.morning-post.example.com/en/1024",
    "morning-post.example.com/world/2021/05/harbour-reopens.html",
    "blog.therin.example.net/en/770",
    "blog.tionor.example.com/fr/15",
    "m.erhand.example.org/de/88123",
    "www.onthre.example.net/es/4031/",
    "thoring.example.com/en/26.html",
    "stener.example.org/en/9182",
    "m.anthea.example.net/en/35/",
    "www.ertion.example.org/fr/7781.html",
    "blog.heshin.example.com/de/61207",
    "lyouth.example.net/es/5",
    "enther.example.com/en/48211.html",
    "blog.reheat.example.org/en/12/",
    "m.ndhaou.example.com/fr/904",
    "thblea.example.net/de/3310.html",
    "www.inhewh.example.com/en/27419",
    "edther.example.org/es/6620/",
    "whestor.example.net/en/18",
    "blog.ouesan.example.net/en/73005",
    "m.thated.example.org/en/410.html",
    "www.nterly.example.com/de/2907/",
    "shanin.example.com/fr/11850",
    "atreon.example.org/en/365",
    "docs.linenpress.example.org/guide/install.html",
    "docs.linenpress.example.org/en/latest/tutorial",
    "wiki.gardeners.example.org/wiki/Tomato",
    "en.wiki.example.org/wiki/History_of_printing",
    "fr.wiki.example.org/wiki/Imprimerie",
    "library.smalltown.example.edu/catalogue/5521",
    "www.university.example.edu/courses/biology/101",
    "cs.university.example.edu/people/staff",
    "shop.woodcraft.example.com/products/oak-table",
    "shop.woodcraft.example.com/cart",
    "recipes.kitchen.example.com/soups/leek-and-potato",
    "www.kitchen.example.com/fr/recettes/tarte",
    "news.valley.example.net/2020/11/03/council-vote",
    "weather.valley.example.net/forecast/tomorrow",
    "forum.cyclists.example.org/thread/22917",
    "forum.cyclists.example.org/en/thread/81?",
    "www.museum.example.org/exhibitions/summer",
    "www.museum.example.org/de/ausstellungen/sommer",
    "blog.astronomer.example.com/posts/lunar-eclipse",
    "travel.mountains.example.com/en/trails/42",
    "www.railways.example.org/timetable",
    "health.clinic.example.org/en/vaccination",
    "www.pharmacy-school.example.edu/admissions",
    "www.chess-club.example.org/results/2019",
    "sports.daily.example.com/football/standings",
    "www.cityhall.example.gov/services/permits",
    "data.cityhall.example.gov/en/datasets/310",
    "code.workshop.example.io/project/readme",
    "www.bookshop.example.com/authors/shelley",
    "music.archive.example.org/albums/7",
    "photo.archive.example.org/albums/harbour",
    "www.insurance-advice.example.org/en/55",
    "www.farmers-market.example.com/stalls",
    "farm-school.example.org/en/81",
    "www.adults-learning.example.org/en/60",
    "tracks.railways.example.org/map",
    "www.free-library.example.org/en/4",
    "win-river.example.org/en/300.html",
    "cheap-flights-guide.example.com/en/2",
    "tionea.example.net/en/2210?",
    "blog.ththor.example.net/en/41883",
    "m.thstat.example.net/fr/1202/",
    "www.theron.example.net/en/56011.html",
    "thshes.example.net/de/7",
    "blog.ththes.example.net/es/30544/",
    "ththin.example.net/en/99.html",
    "m.tioned.example.net/en/18270",
    "tionth.example.com/en/3307",
    "www.thblth.example.com/en/640.html",
    "blog.thouth.example.com/es/25/",
    "thenth.example.org/en/48120",
    "m.ththea.example.org/en/7312/",
    "www.thtion.example.org/de/1055.html",
    "ethand.example.net/en/36",
    "hender.example.net/fr/20981",
    "blog.onshre.example.net/en/4420.html",
    "aterin.example.com/de/512/",
    "esoned.example.org/es/69034",
    "blog.ineare.example.com/en/8",
    "velmor.example.net/en/13",
    "kastun.example.net/pl/450",
    "www.sorund.example.net/en/7788/",
    "m.dalpen.example.net/en/23.html",
    "example.com/",
    "example.org/en/1",
    "example.net/fr/2.html",
    "www.example.com/about",
    "www.example.org/es/90",
)

# Spam, gambling, adult, pill and tracking sites.
BLOCKED = (
    "www.cheap-pills.example.com/en/103",
    "cheap-pills.example.net/buy/now",
    "blog.cheap-pills.example.org/fr/77.html",
    "pills-online.example.com/order",
    "best-pills-shop.example.net/de/5",
    "viagra-discount.example.com/buy",
    "casino-win.example.net/en/88",
    "www.casino-win.example.com/play",
    "m.casino-win.example.org/es/3120/",
    "big-casino.example.com/bonus",
    "online-casino-slots.example.net/spin",
    "jackpot-casino.example.org/fr/9",
    "slots-jackpot.example.com/win",
    "poker-bets.example.net/join",
    "free-bets.example.net/en/4410",
    "www.free-bets.example.com/de/12.html",
    "blog.free-bets.example.org/signup",
    "sport-bets.example.com/odds",
    "adult-x.example.com/en/51",
    "www.adult-x.example.net/video",
    "m.adult-x.example.org/es/8",
    "adult-cams.example.com/live",
    "xxx-videos.example.net/watch",
    "hot-xxx.example.com/gallery",
    "porn-tube.example.org/video/771",
    "ads-track.example.com/en/60212",
    "www.ads-track.example.net/pixel",
    "m.ads-track.example.org/fr/31/",
    "ads-server.example.com/banner",
    "click-track.example.net/redirect",
    "spam-farm.example.org/en/3005",
    "www.spam-farm.example.com/de/1.html",
    "blog.spam-farm.example.net/links",
    "link-farm.example.com/seo",
    "seo-spam.example.net/backlinks",
    "spam-links.example.org/es/40",
    "blog.spam-farm.example.org/en/20817/",
    "m.spam-farm.example.org/en/455",
    "spam-blog.example.org/en/9.html",
    "www.spam-farm.example.org/fr/71002",
    "blog.casino-win.example.org/en/15",
    "www.ads-track.example.org/en/390.html",
    "payday-loans-now.example.com/apply",
    "instant-loans.example.net/cash",
    "crypto-doubler.example.com/invest",
    "free-crypto-giveaway.example.org/claim",
    "replica-watches.example.com/rolex",
    "cheap-replica.example.net/bags",
    "win-free-prize.example.com/claim",
    "free-prize-winner.example.org/iphone",
    "miracle-diet-pills.example.com/buy",
    "weight-loss-pills.example.net/order",
    "warez-download.example.com/crack",
    "keygen-crack.example.net/serial",
)
