"""Fixed values of the knowledge-graph operators."""

# Labels of heads and tails that are dropped.
META_LABELS = (
    "Wikimedia disambiguation page",
    "Wikimedia category",
    "Wikimedia list",
    "Wikimedia information list",
    "Wikimedia internal item",
    "Wikimedia article covering multiple topics",
    "Wikimedia article covering two opposite properties or topics",
    "MediaWiki main namespace page",
    "disambiguation page",
    "Wikipedia disambiguation page",
)
# Relations that are dropped.
STOP_RELATIONS = (
    "topic's main category", "category's main topic", "on focus list of Wikimedia project", "described by source", "properties for this type", "said to be the same as",
    "different from", "Wikimedia import URL", "Freebase ID", "Quora topic ID", "Google Knowledge Graph ID", "external data available at", "page banner",
    "located on street", "street address", "postal code", "official website", "Commons category", "image", "logo image", "locator map image", "detail map",
    "coat of arms image", "flag image", "seal image", "has list", "related image", "audio", "video", "pronunciation audio", "described at URL", "reference URL",
    "ISBN-13", "ISBN-10", "DOI", "PubMed ID", "arXiv ID", "Library of Congress authority ID", "VIAF ID", "GND ID", "BNF ID", "ORCID ID", "ISNI", "IMDb ID",
    "MusicBrainz artist ID", "Discogs artist ID", "AllMusic artist ID", "X username", "Facebook username", "Instagram username", "YouTube channel ID",
    "LinkedIn company ID", "GitHub username", "Stack Exchange tag", "Twitter username", "subreddit",
)
# Property ids of relation labels.
RELATION_PIDS = {
    "instance of": "P31", "subclass of": "P279", "part of": "P361", "has part(s)": "P527", "country": "P17", "country of citizenship": "P27",
    "place of birth": "P19", "date of birth": "P569", "date of death": "P570", "occupation": "P106", "position held": "P39",
    "member of": "P463", "member of political party": "P102", "spouse": "P26", "father": "P22", "mother": "P25", "child": "P40",
    "educated at": "P69", "employer": "P108", "director": "P57", "cast member": "P161", "producer": "P162", "screenwriter": "P58",
    "author": "P50", "creator": "P170", "manufacturer": "P176", "owned by": "P127", "parent organization": "P749", "subsidiary": "P355",
    "headquarters location": "P159", "located in the administrative territorial entity": "P131", "location": "P276", "capital": "P36",
    "shares border with": "P47", "sex or gender": "P21", "genre": "P136", "language of work or name": "P407", "named after": "P138",
    "inception": "P571", "dissolved, abolished or demolished date": "P576", "contains the administrative territorial entity": "P150",
    "head of government": "P6", "head of state": "P35", "population": "P1082", "area": "P2046", "elevation above sea level": "P2044",
    "official language": "P37", "currency": "P38", "time zone": "P421", "coordinate location": "P625", "described by source": "P1343",
    "properties for this type": "P1963", "said to be the same as": "P460", "different from": "P1889", "topic's main category": "P910",
}
# Property ids that a question's keyword points to.
KEYWORD_PIDS = {
    "nationality": ("P27",), "country": ("P17", "P27"), "citizen": ("P27",), "born": ("P19",), "birth": ("P19",), "birthplace": ("P19",),
    "place of birth": ("P19",), "died": ("P20",), "death": ("P20",), "located": ("P131", "P276"), "location": ("P131", "P276"),
    "headquarters": ("P159",), "capital": ("P36",), "occupation": ("P106",), "job": ("P106",), "profession": ("P106",),
    "position": ("P39",), "role": ("P39", "P286"), "member": ("P463", "P102"), "spouse": ("P26",), "married": ("P26",), "wife": ("P26",),
    "husband": ("P26",), "parent": ("P25", "P22"), "father": ("P22",), "mother": ("P25",), "child": ("P40",), "son": ("P40",),
    "daughter": ("P40",), "brother": ("P3373",), "sister": ("P9",), "director": ("P57",), "directed": ("P57",),
    "film": ("P57", "P161", "P162"), "movie": ("P57", "P161"), "wrote": ("P50",), "author": ("P50",), "written": ("P50",),
    "producer": ("P162",), "produced": ("P162",), "starring": ("P161",), "cast": ("P161",), "actor": ("P161",), "actress": ("P161",),
    "album": ("P175",), "song": ("P175",), "music": ("P175",), "band": ("P463",), "group": ("P463",), "founded": ("P112",),
    "founder": ("P112",), "company": ("P112", "P355"), "subsidiary": ("P355",), "owner": ("P127",), "owned": ("P127",),
    "manufacturer": ("P176",), "built": ("P176",), "university": ("P69",), "college": ("P69",), "school": ("P69",), "educated": ("P69",),
    "alumnus": ("P69",), "degree": ("P512",), "team": ("P54",), "club": ("P54",), "player": ("P54",), "coach": ("P286",),
    "league": ("P118",), "stadium": ("P115",), "arena": ("P115",), "championship": ("P1346",), "tournament": ("P1346",),
}
# Relations under a quota of one for each head, and the penalties of relations that say little.
TAXONOMIC = ("P31", "P279")
PENALTIES = {"P31": 0.35, "P279": 0.35, "P527": 0.20, "P361": 0.15}
# Shares of one relation, and of taxonomic relations in the result.
RELATION_SHARE, TAXONOMIC_SHARE = 0.15, 0.20
# What the parts of a severed triple are replaced by.
NOISE_ENTITIES = ("Random Organization", "Unknown Person", "Fictional Place", "Unrelated Entity", "Placeholder Entity")
NOISE_RELATIONS = ("unrelated_to", "does_not_affect", "is_irrelevant_to", "has_no_connection_with", "is_distinct_from")
# Entities and descriptions of pages that are no entity.
PAGE_ENTITIES = ("Q4167410", "Q11266439", "Q13406463")
PAGE_DESCRIPTIONS = (
    "wikimedia disambiguation page", "wikimedia category", "wikimedia list", "wikimedia template", "wikipedia disambiguation page", "wikipedia category",
)
