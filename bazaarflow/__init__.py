"""Spark jobs for multi-tenant shop assistants: catalogues, FAQs, messages and chat logs."""
