"""loanlens.plans"""
