"""Readers and writers of books, word lists, requests, results and manifests."""
