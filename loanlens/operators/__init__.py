"""loanlens.operators"""
