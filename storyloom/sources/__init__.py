"""Normalisers by source kind: a frame of fetched payloads in, items out."""

from storyloom.sources import apis, feeds

NORMALISERS = {
    "rss": feeds.normalise,
    "arxiv": feeds.normalise_papers,
    "hn": lambda payloads: apis.discussions(apis.hits(payloads)),
    "hf_models": apis.models,
    "hf_datasets": apis.datasets,
    "hf_papers": apis.daily_papers,
    "github": apis.releases,
}


def normalise(kind: str, payloads):
    """Items of one kind of source; an unknown kind is refused by name."""
    if kind not in NORMALISERS:
        raise ValueError(f"unknown source kind {kind!r} (known: {', '.join(sorted(NORMALISERS))})")
    return NORMALISERS[kind](payloads)
