"""Word lists whose values are fixed: results must agree with them word for word."""

from __future__ import annotations

#: Words that tell financial content.
FINANCIAL = (
    "earnings", "dividend", "acquisition", "merger", "revenue", "profit", "loss",
    "shares", "ipo", "sec", "inflation", "fed", "interest rate", "recession",
    "bullish", "bearish", "ticker", "stock", "etf", "nasdaq", "nyse", "sp500",
    "treasury", "yield", "commodity", "crude", "crypto", "bitcoin", "short squeeze",
    "war", "conflict", "sanctions", "tariff", "trade war", "military", "invasion",
    "geopolitical", "central bank", "gdp", "employment", "unemployment",
    "jobs report", "cpi", "ppi", "consumer price", "producer price",
    "manufacturing", "pmi", "industrial production", "retail sales",
    "monetary policy", "fiscal policy", "stimulus",
    "government shutdown", "debt ceiling", "budget deficit",
    "market crash", "volatility", "vix",
    "supply chain", "regulation", "regulatory", "antitrust",
    "pandemic", "lockdown", "rate hike", "rate cut",
    "economic growth", "consumer spending", "labor market", "wage",
    "housing market",
    "corporate bond", "credit market",
    "bankruptcy", "default", "downgrade", "credit rating",
    "currency", "forex", "dollar", "euro", "yen", "yuan",
    "energy", "oil", "gas", "natural gas", "gold", "silver",
    "semiconductor", "chip",
    "presidential", "legislation",
    "fed chair", "federal reserve", "rate decision",
)

#: Words of social posts that tell the same.
SOCIAL = (
    "calls", "puts", "yolo", "bagholder", "shorts", "hedgies", "options",
    "strike", "expiration", "liquidation", "margin call", "apes", "moon", "drill",
    "diamond hands", "paper hands", "tendies", "rug pull", "stonks", "loss porn",
    "gain porn", "pump and dump", "fomo", "btfd", "wendys", "wife's boyfriend",
)

#: Short words in capitals that are no tickers.
NO_TICKERS = (
    "THE", "AND", "FOR", "OUT", "NEW", "NOW", "ALL", "BUT", "HAS", "ITS",
    "ARE", "NOT", "WHO", "HOW", "WHY", "YOU", "OUR", "GET", "CAN", "ONE",
    "LOL", "OMG", "WTF", "DIY", "FAQ", "OS", "PC", "TV", "CPU", "GPU", "RAM", "SSD",
)

#: What tells that a text speaks of a coming event.
EVENT = (
    "earnings", "product launch", "investor day", "fda decision", "fda approval",
    "conference", "dividend", "stock split", "share buyback", "acquisition",
    "merger", "annual meeting", "keynote", "product event", "unveil", "release date",
    "clinical trial", "phase 3", "regulatory decision", "sec filing",
)

#: What tells of a company going public: alone, or only beside a word of the third list.
LISTING_STRONG = (
    "ipo", "initial public offering", "going public", "public listing",
    "direct listing", "s-1 filing", "f-1 filing", "prices its offering",
    "stock market debut", "market debut", "trading debut",
)
LISTING_WEAK = (
    "debut", "listed on", "begins trading", "publicly traded", "spac",
    "offering price", "share sale",
)
LISTING_CONTEXT = (
    "ipo", "offering", "listing", "flotation", "shares priced", "nasdaq debut",
    "nyse debut", "underwriter", "bookrunner", "prospectus",
)

#: Words by which a side's argument is told.
BULLISH = (
    "bullish", "upside", "growth", "catalyst", "buy", "long", "outperform",
    "beat", "strong", "positive", "opportunity", "momentum", "rally",
)
BEARISH = (
    "bearish", "downside", "risk", "headwind", "sell", "short", "underperform",
    "decline", "weak", "negative", "concern", "overvalued", "correction", "crash",
)

#: The legal forms that end a name, in the order in which they are tried, each once;
#: the short ones may have a dot behind them.
LEGAL_FORMS = ("incorporated", "corporation", "holdings", "inc", "corp", "ltd", "llc", "limited", "group", "co", "plc", "lp", "llp", "l.p")
SHORT_FORMS = ("inc", "corp", "ltd", "llc", "co", "lp", "llp", "l.p")
