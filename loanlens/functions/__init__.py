"""loanlens.functions"""
