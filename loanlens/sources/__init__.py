"""loanlens.sources"""
