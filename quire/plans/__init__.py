"""Builders that collect what is to be done and make one pass of it; nothing runs before an action."""
