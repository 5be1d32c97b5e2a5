"""Named queries. Importing this package registers all of them."""

from . import conversations, decisions, dialogues, events, live, metrics, picks, records, relational, requests, scores, streams, texts  # noqa: F401
