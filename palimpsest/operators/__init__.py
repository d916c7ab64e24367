"""Conversation memory operators as DataFrame -> DataFrame functions."""
