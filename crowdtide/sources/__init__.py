"""Readers and writers of posts, annotations, mail and graphs."""
