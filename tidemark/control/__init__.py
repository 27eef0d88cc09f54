"""tidemark.control"""
