"""Training-data operators: quality, contamination, copies, tokens, languages, personal data, pages, chats."""
